"""Deeply nested JSON texts to flat, linked tables by vectorised structural indexing.

A batch of texts is one byte array.  Bitmaps mark quotes that are not escaped, the inside of
strings, brackets and delimiters; prefix sums over them give the nesting depth; the depth gives
every token its container and every bracket its partner.  Grammar is checked on the same arrays,
so a text is readable or not without a second parser.  Rows are cut out as spans by selecting
tokens whose container and key match a path.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are indexed at once; a longer text is indexed alone.
CHUNK_BYTES = 2 << 20

OBJ, END_OBJ, ARR, END_ARR, COLON, COMMA, STRING, SCALAR = range(1, 9)

_KIND = np.zeros(256, np.int8)
for _char, _kind in zip(b"{}[]:,", range(1, 7), strict=True):
    _KIND[_char] = _kind
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
_NUMERIC = np.zeros(256, bool)
_NUMERIC[list(b"0123456789+-.eE")] = True
_DIGIT, _HEX, _ESCAPED = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPED[list(b'"\\/bfnrtu')] = True


@dataclass(frozen=True)
class Link:
    """A child table: objects (or plain values) under ``child`` of the objects at ``parents``.

    parents    keys from the document's root to the parent objects; () is the root itself
    parent_id  key of the parent's id
    child      key that holds the children: a list, an object keyed by position or id, a single
               object, or for plain values a single string; None for the document itself
    child_id   key of the child's id; None when the children are plain values, POSITION when their place
               among their parent's children is to stand for an id
    """

    table: str
    parents: tuple[str, ...]
    child: str | None
    child_id: str | None
    parent_id: str = "id"


POSITION = "#"


TENDER_LINKS = (
    Link("lot_values", ("bids",), "lotValues", "relatedLot"),
    Link("awards", (), "awards", "id"),
    Link("changes", (), "changes", "id"),
    Link("rationale_types", ("changes",), "rationaleTypes", None),
)
#: Keys under which a document may be wrapped.
WRAPPERS = ("data", "response")


class Tape:
    """Tokens of many texts: kind, span, container and key of each, and which texts are readable."""

    def __init__(self, texts: list[bytes]):
        self.texts = len(texts)
        raw = b"\n".join(texts) + b"\n"
        self.raw = raw
        b = np.frombuffer(raw, np.uint8)
        n = len(b)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        starts = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        position = np.arange(n, dtype=np.int32)

        quote = b == 0x22
        slash = b == 0x5C
        if slash.any():
            run = position - np.maximum.accumulate(np.where(slash, np.int32(-1), position))
            escaped = np.zeros(n, bool)
            escaped[1:] = (run[:-1] & 1).astype(bool)
            quote &= ~escaped
        quotes = np.cumsum(quote, dtype=np.int32)
        before = quotes[starts] - quote[starts]
        inside = ((quotes - before[doc]) & 1).astype(bool)

        good = ~inside[starts + lengths - 1]
        control = inside & (b < 0x20)
        if control.any():
            good[doc[control]] = False
        if slash.any():
            self._check_escapes(b, doc, np.flatnonzero(slash & inside & ~escaped), good)

        outside = ~inside & ~quote
        structural = outside & (_KIND[b] > 0)
        plain = outside & ~structural & ~_SPACE[b]
        plain_start = plain.copy()
        plain_start[1:] &= ~plain[:-1]
        opening = quote & inside
        token = structural | opening | plain_start
        at = np.flatnonzero(token).astype(np.int32)
        at = at[good[doc[at]]]
        kind = np.where(opening[at], STRING, np.where(plain_start[at], SCALAR, _KIND[b[at]])).astype(np.int8)
        self._set(b, doc, at, kind, quote, plain, good)

    def _check_escapes(self, b, doc, at, good):
        """A backslash stands before one of the letters it may, u before four hexadecimal digits."""
        padded = np.append(b, np.zeros(5, np.uint8))
        sign = padded[at + 1]
        ok = _ESCAPED[sign]
        coded = sign == 0x75
        for k in range(2, 6):
            ok &= ~coded | _HEX[padded[at + k]]
        good[doc[at[~ok]]] = False

    def _check_numbers(self, b, tokens):
        """Which scalar tokens made of numeric bytes are JSON numbers."""
        start, stop = self.at[tokens], self.end[tokens]
        digit = _DIGIT[b]
        after, before = np.append(digit[1:], False), np.append(False, digit[:-1])
        point, power = b == 0x2E, (b == 0x65) | (b == 0x45)
        sign = (b == 0x2B) | (b == 0x2D)
        first = np.zeros(len(b), bool)
        first[start] = True
        behind_power = np.append(False, power[:-1])
        # a point between digits, a power behind one and before one or a sign, a sign first (minus only) or behind a power, before a digit
        wrong = (point & ~(before & after)) | (power & ~(before & (after | np.append(sign[1:], False)))) | (sign & ~(((first & (b == 0x2D)) | behind_power) & after))
        # no digit behind a leading zero
        leads = (first | np.append(False, (first & sign)[:-1])) & (b == 0x30)
        wrong |= leads & after
        ok = digit[stop - 1]
        for mask, most in ((wrong, 0), (point, 1), (power, 1)):
            total = np.r_[0, np.cumsum(mask, dtype=np.int64)]
            ok &= total[stop] - total[start] <= most
        # no point behind a power
        powers = np.r_[0, np.cumsum(power, dtype=np.int64)]
        late = np.r_[0, np.cumsum(point & (powers[:-1] > powers[self._owner(b, start, stop)]), dtype=np.int64)]
        return ok & (late[stop] == late[start])

    @staticmethod
    def _owner(b, start, stop):
        """For every byte the start of the token it lies in, 0 outside."""
        out = np.zeros(len(b), np.int64)
        sizes = (stop - start).astype(np.int64)
        places = np.repeat(start.astype(np.int64) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out[places] = np.repeat(start, sizes)
        return out

    def _set(self, b, doc, at, kind, quote, plain, good):
        in_doc = doc[at]
        end = at + 1
        is_string, is_scalar = kind == STRING, kind == SCALAR
        if is_string.any():
            quote_at = np.flatnonzero(quote).astype(np.int32)
            end[is_string] = quote_at[np.searchsorted(quote_at, at[is_string]) + 1] + 1
        if is_scalar.any():
            last = plain.copy()
            last[:-1] &= ~plain[1:]
            stops = np.flatnonzero(last).astype(np.int32)
            end[is_scalar] = stops[np.searchsorted(stops, at[is_scalar])] + 1

        opens, closes = (kind == OBJ) | (kind == ARR), (kind == END_OBJ) | (kind == END_ARR)
        step = opens.astype(np.int32) - closes
        depth = np.cumsum(step, dtype=np.int32)
        if len(at):
            first = np.flatnonzero(np.r_[True, in_doc[1:] != in_doc[:-1]])
            base = (depth - step)[first]
            size = np.diff(np.r_[first, len(at)])
            depth = depth - np.repeat(base, size)
            low = np.minimum.reduceat(depth, first)
            final = depth[np.r_[first[1:], len(at)] - 1]
            good[in_doc[first[(low < 0) | (final != 0)]]] = False
        present = np.zeros(self.texts, bool)
        present[in_doc] = True
        good &= present
        keep = good[in_doc]
        if not keep.all():
            at, kind, end, in_doc, depth = (x[keep] for x in (at, kind, end, in_doc, depth))
            opens, closes = opens[keep], closes[keep]
        level = depth - opens  # depth around the token
        self._containers(level, opens, closes, kind)
        self.at, self.end, self.kind, self.doc, self.level = at, end, kind, in_doc, level
        self._check(b, good)
        self.good = good

    def _containers(self, level, opens, closes, kind):
        n = len(level)
        self.container = np.full(n, -1, np.int32)
        self.partner = np.full(n, -1, np.int32)
        order = np.argsort(level, kind="stable").astype(np.int32)
        cuts = np.searchsorted(level[order], np.arange((level.max() if n else 0) + 2))
        outer = None
        for d in range(len(cuts) - 1):
            here = order[cuts[d] : cuts[d + 1]]
            if outer is not None and len(outer):
                self.container[here] = outer[np.searchsorted(outer, here) - 1]
            mine, theirs = here[opens[here]], here[closes[here]]
            self.partner[mine], self.partner[theirs] = theirs, mine
            outer = mine

    def _check(self, b, good):
        kind, n = self.kind, len(self.kind)
        if not n:
            self.key, self.value = np.full(0, -1, np.int32), np.zeros(0, bool)
            return
        first = np.r_[True, self.doc[1:] != self.doc[:-1]]
        previous = np.r_[np.int8(0), kind[:-1]]
        previous[first] = 0
        around = np.where(self.container >= 0, kind[self.container], 0)
        is_key = (kind == STRING) & (around == OBJ) & ((previous == OBJ) | (previous == COMMA))
        ends = ((kind == STRING) & ~is_key) | (kind == SCALAR) | (kind == END_OBJ) | (kind == END_ARR)
        previous_ends = np.r_[False, ends[:-1]] & ~first
        previous_key = np.r_[False, is_key[:-1]] & ~first
        value = (kind == OBJ) | (kind == ARR) | (kind == SCALAR) | ((kind == STRING) & ~is_key)
        close = (kind == END_OBJ) | (kind == END_ARR)
        ok = np.where(
            value,
            np.where(around == OBJ, previous == COLON, np.where(around == ARR, (previous == ARR) | (previous == COMMA), first)),
            np.where(kind == COLON, previous_key, np.where(kind == COMMA, previous_ends & (around > 0), True)),
        )
        if close.any():
            opener = kind[self.partner[close]]
            ok[close] = (opener == kind[close] - 1) & (previous_ends[close] | (previous[close] == opener))
        scalar = np.flatnonzero(kind == SCALAR)
        if len(scalar):
            odd = np.r_[0, np.cumsum(~_NUMERIC[b], dtype=np.int64)]
            named = odd[self.end[scalar]] != odd[self.at[scalar]]
            worded, numbers = scalar[named], scalar[~named]
            ok[numbers] &= self._check_numbers(b, numbers)
            word = np.zeros(len(worded), bool)
            for text in (b"true", b"false", b"null"):
                word |= self._equals(worded, text, self.at, 0)
            ok[worded] &= word
        good[self.doc[~ok]] = False
        self.key = np.full(n, -1, np.int32)
        members = np.flatnonzero(value & (around == OBJ))
        self.key[members] = members - 2
        self.value = value & good[self.doc]

    def _equals(self, tokens, text, starts, quotes):
        """Which tokens have exactly the bytes ``text`` between ``quotes`` bytes on either side."""
        b = np.frombuffer(self.raw, np.uint8)
        right = self.end[tokens] - starts[tokens] - 2 * quotes == len(text)
        chosen = tokens[right]
        same = (b[starts[chosen][:, None] + quotes + np.arange(len(text))] == np.frombuffer(text, np.uint8)).all(axis=1)
        out = np.zeros(len(tokens), bool)
        out[np.flatnonzero(right)[same]] = True
        return out

    def under(self, name: str) -> np.ndarray:
        """Value tokens that stand under the key ``name``."""
        members = np.flatnonzero(self.value & (self.key >= 0))
        return members[self._equals(self.key[members], name.encode(), self.at, 1)]

    def text(self, token: int) -> str | None:
        """A string's content or a number's or boolean's text; None for null and containers."""
        span = self.raw[self.at[token] : self.end[token]]
        if self.kind[token] == STRING:
            if b"\\" in span:
                try:
                    return json.loads(span)
                except ValueError:
                    return span[1:-1].decode("utf-8", "replace")
            return span[1:-1].decode("utf-8", "replace")
        if self.kind[token] == SCALAR and span != b"null":
            return span.decode()
        return None

    def span(self, token: int) -> str:
        stop = self.end[self.partner[token]] if self.partner[token] >= 0 else self.end[token]
        return self.raw[self.at[token] : stop].decode("utf-8", "replace")


def _roots(tape: Tape) -> np.ndarray:
    """Each text's document: its root object, or what it wraps; -1 for texts without one."""
    root = np.full(tape.texts, -1, np.int32)
    if not len(tape.kind):
        return root
    top = np.flatnonzero(tape.value & (tape.level == 0))
    root[tape.doc[top]] = top
    has_id = np.zeros(len(tape.kind) + 1, bool)
    has_id[tape.container[tape.under("id")]] = True
    inner = np.full(len(tape.kind) + 1, -1, np.int32)
    for name in WRAPPERS:
        below = tape.under(name)
        inner[tape.container[below]] = below
    while True:
        wrapped = (root >= 0) & ~has_id[root] & (inner[root] >= 0)
        if not wrapped.any():
            return root
        root = np.where(wrapped, inner[root], root)


def _children(tape: Tape, parents: np.ndarray, name: str, child_id: str | None):
    """(element tokens, their parents) for the children of the object tokens in ``parents``."""
    chosen = np.zeros(len(tape.kind) + 1, bool)
    chosen[parents] = True
    held = tape.under(name)
    held = held[chosen[tape.container[held]]]
    kinds = tape.kind[held]
    single = held[(kinds == STRING) if child_id is None else np.zeros(len(held), bool)]
    many = held[kinds == ARR]
    objects = held[kinds == OBJ]
    if len(objects):
        inside = np.flatnonzero(tape.value & (tape.container >= 0))
        flat = np.zeros(len(tape.kind) + 1, bool)
        leaf = inside[(tape.kind[inside] == STRING) | (tape.kind[inside] == SCALAR)]
        if child_id is None:
            many = np.r_[many, objects]
        else:
            flat[tape.container[leaf]] = True
            flat[tape.container[tape.under(child_id)]] = True
            single = np.r_[single, objects[flat[objects]]]
            many = np.r_[many, objects[~flat[objects]]]
    lists = np.zeros(len(tape.kind) + 1, bool)
    lists[many] = True
    elements = np.flatnonzero(tape.value)
    elements = elements[lists[tape.container[elements]] & (tape.container[elements] >= 0)]
    tokens = np.r_[single, elements].astype(np.int64)
    owners = np.r_[tape.container[single], tape.container[tape.container[elements]]].astype(np.int64)
    if child_id is not None:
        is_object = tape.kind[tokens] == OBJ
        tokens, owners = tokens[is_object], owners[is_object]
    order = np.argsort(tokens, kind="stable")
    return tokens[order], owners[order]


def extract(texts: list[str | None], links: tuple[Link, ...], payload: bool) -> list[tuple | None]:
    """Per text None if it can't be read, else (root id, [(table, parent id, child id, ordinal, payload)]).

    Readable means: valid JSON whose root, after unwrapping, is an object; a JSON string that
    itself holds such a text is read too.
    """
    out: list[tuple | None] = [None] * len(texts)
    encoded = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    start = 0
    while start < len(encoded):
        stop, size = start + 1, len(encoded[start])
        while stop < len(encoded) and size + len(encoded[stop]) <= CHUNK_BYTES:
            size += len(encoded[stop])
            stop += 1
        out[start:stop] = _extract_chunk(encoded[start:stop], links, payload)
        start = stop
    return out


def _extract_chunk(encoded: list[bytes], links: tuple[Link, ...], payload: bool) -> list[tuple | None]:
    tape = Tape(encoded)
    root = _roots(tape)
    out: list[tuple | None] = [None] * len(encoded)
    again: list[int] = []
    for i in np.flatnonzero(tape.good & (root >= 0)):
        if tape.kind[root[i]] == OBJ:
            out[i] = (None, [])
        elif tape.kind[root[i]] == STRING:
            again.append(i)
    documents = root[[i for i, x in enumerate(out) if x is not None]].astype(np.int64)
    ids = {}

    def id_of(key):
        if key not in ids:
            held = tape.under(key)
            ids[key] = dict(zip(tape.container[held].tolist(), held.tolist(), strict=True))
        return ids[key]

    def named(owner, key):
        token = id_of(key).get(owner)
        text = None if token is None else tape.text(token)
        return text if text is not None and text.strip() else None

    for r in documents.tolist():
        out[tape.doc[r]] = (named(r, "id"), out[tape.doc[r]][1])
    for link in links:
        parents = documents
        for name in link.parents:
            parents, _ = _children(tape, parents, name, link.parent_id)
        tokens, owners = (parents, parents) if link.child is None else _children(tape, parents, link.child, link.child_id)
        ordinal, last = 0, None
        for token, owner in zip(tokens.tolist(), owners.tolist(), strict=True):
            ordinal = ordinal + 1 if owner == last else 0
            last = owner
            parent = named(owner, link.parent_id)
            if link.child_id is None:
                child = tape.text(token)
                child = child.strip() if child is not None else None
            elif link.child_id == POSITION:
                child = str(ordinal)
            else:
                child = named(token, link.child_id)
            if parent is None or not child:
                continue
            out[tape.doc[token]][1].append((link.table, parent, child, ordinal, tape.span(token) if payload else None))
    if again:
        inner = extract([tape.text(root[i]) for i in again], links, payload)
        for i, found in zip(again, inner, strict=True):
            out[i] = found
    return out


_LINKS = "array<struct<child_table:string,parent_id:string,child_id:string,ordinal:int,payload:string>>"


def parse_documents(df: DataFrame, body: str, links: tuple[Link, ...], payload: bool = False) -> DataFrame:
    """``df`` without ``body`` plus ``root_id`` and ``links``; ``links`` is null where the text can't be read.

    Nulls, empty texts, cut-off and malformed texts are unreadable, never an error.  Texts of any
    length are read whole.
    """
    kept = [c for c in df.columns if c != body]
    link_type = pa.list_(
        pa.struct(
            [("child_table", pa.string()), ("parent_id", pa.string()), ("child_id", pa.string()), ("ordinal", pa.int32()), ("payload", pa.string())]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = 256
            for offset in range(0, batch.num_rows, step):
                piece = batch.slice(offset, step)
                found = extract(piece.column(body).to_pylist(), links, payload)
                columns = [piece.column(c) for c in kept]
                columns.append(pa.array([None if x is None else x[0] for x in found], pa.string()))
                rows = [
                    None if x is None else [dict(zip(("child_table", "parent_id", "child_id", "ordinal", "payload"), r, strict=True)) for r in x[1]]
                    for x in found
                ]
                columns.append(pa.array(rows, link_type))
                yield pa.RecordBatch.from_arrays(columns, [*kept, "root_id", "links"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema), "root_id string", f"links {_LINKS}"])
    return df.mapInArrow(run, schema)


def latest_links(records: DataFrame, links: tuple[Link, ...] = TENDER_LINKS, payload: bool = False) -> DataFrame:
    """(object_id, child_table, parent_id, child_id, ordinal, payload) of each object's latest readable version.

    Latest is by the instant of ``date_modified``, then ``fetched_at``, then ``record_id``; a date
    that can't be read is earlier than any other.  An object without a readable version gives no
    rows.  The newest version is picked by a partial maximum before the shuffle, so an object
    with very many versions is no hot spot.  A record without object_id goes by its root's id.
    """
    parsed = parse_documents(
        records.select("record_id", "object_id", "date_modified", "fetched_at", "body"), "body", links, payload
    ).where("links is not null")
    order = F.struct(
        F.try_to_timestamp("date_modified").alias("at"), F.col("fetched_at"), F.col("record_id")
    )
    newest = parsed.groupBy(F.coalesce("object_id", "root_id").alias("object_id")).agg(
        F.max_by("links", order).alias("links")
    )
    return newest.select("object_id", F.inline("links"))


def distinct_links(links: DataFrame) -> DataFrame:
    """Every link once."""
    return links.select("child_table", "parent_id", "child_id").distinct()
