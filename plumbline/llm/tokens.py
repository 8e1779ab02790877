"""Encoding of a corpus with a public byte-level BPE vocabulary.

Texts are turned into arrays of code points and of symbols: classes (letter, number, white space, other),
told apart by what follows where that matters.  Every symbol is a function from the states of a small automaton to
its states; composing functions is associative, so the states at all places come from a blocked scan over arrays, without a
regular expression, and with them where pieces start.  The pieces are then merged by rank, each distinct piece
once per worker.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Where the ranks of the vocabulary are, unless a caller says otherwise.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pieces whose ids a worker remembers.
CACHE_PIECES = 400_000
#: Code points that are split at once; a longer text is split alone.
CHUNK_POINTS = 1 << 20

SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
#: The code points with the property White_Space.
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: What may follow an apostrophe in a contraction.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def point_classes() -> np.ndarray:
    """The class of every code point, and EDGE for one beyond them."""
    kinds = np.full(0x110001, OTHER, np.int8)
    category = unicodedata.category
    for point in range(0x110000):
        first = category(chr(point))[0]
        if first == "L":
            kinds[point] = LETTER
        elif first == "N":
            kinds[point] = NUMBER
    kinds[list(WHITE_SPACE)] = SPACE
    kinds[0x110000] = EDGE
    return kinds


#: States of the automaton: after an edge, inside letters, numbers, others or white space, after a blank that goes with the
#: next piece, one or two letters before a contraction's end, after it.
AT_EDGE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACE, BEFORE_PIECE, ONE_LEFT, TWO_LEFT, CONTRACTED = range(9)
#: Symbols beyond the classes: white space before a piece (a blank joins it, other does not), apostrophes that begin a
#: contraction of one or two letters.
JOINING_BLANK, LAST_SPACE, APOSTROPHE_1, APOSTROPHE_2 = range(5, 9)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts) by symbol and state."""
    moves, starts = np.zeros((9, 9), np.int8), np.ones((9, 9), bool)
    goes_on = {LETTER: (IN_LETTERS, (IN_LETTERS, BEFORE_PIECE)), NUMBER: (IN_NUMBERS, (IN_NUMBERS, BEFORE_PIECE)), OTHER: (IN_OTHERS, (IN_OTHERS, BEFORE_PIECE)), SPACE: (IN_SPACE, (IN_SPACE,))}
    for symbol, (state, inside) in goes_on.items():
        moves[symbol] = state
        starts[symbol, list(inside)] = False
    moves[LETTER, TWO_LEFT], moves[LETTER, ONE_LEFT] = ONE_LEFT, CONTRACTED
    starts[LETTER, [TWO_LEFT, ONE_LEFT]] = False
    moves[EDGE], moves[JOINING_BLANK], moves[LAST_SPACE] = AT_EDGE, BEFORE_PIECE, IN_SPACE
    for symbol, state in ((APOSTROPHE_1, ONE_LEFT), (APOSTROPHE_2, TWO_LEFT)):
        moves[symbol] = state
        moves[symbol, [IN_OTHERS, BEFORE_PIECE]] = IN_OTHERS
        starts[symbol, [IN_OTHERS, BEFORE_PIECE]] = False
    return moves, starts


MOVES, STARTS = _automaton()


def symbols(points: np.ndarray) -> np.ndarray:
    """The symbol of every code point: its class, changed where what follows matters."""
    kinds = point_classes()[points]
    out = kinds.copy()
    following = np.append(kinds[1:], np.int8(EDGE))
    last = (kinds == SPACE) & (following != SPACE) & (following != EDGE)
    out[last] = np.where(points[last] == 0x20, JOINING_BLANK, LAST_SPACE)
    at = np.flatnonzero((points == 0x27) & (following == LETTER))
    if len(at):
        padded = np.append(points, [0x110000] * 3)
        undecided = np.ones(len(at), bool)
        for tail in CONTRACTIONS:
            same = undecided.copy()
            for k, char in enumerate(tail):
                same &= padded[at + 1 + k] == ord(char)
            out[at[same]] = APOSTROPHE_1 if len(tail) == 1 else APOSTROPHE_2
            undecided &= ~same
    return out


def piece_starts(points: np.ndarray) -> np.ndarray:
    """A mask of where pieces start in code points whose texts are divided by 0x110000.

    The places are laid out in rows.  Each row's symbols are composed to one function, all rows at a time; the functions
    of the rows before give the state in which a row begins; from there the states inside follow, again all rows at a time.
    """
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    width = max(1, int(n**0.5))
    rows = -(-n // width)
    laid = np.full(rows * width, EDGE, np.int8)
    laid[:n] = symbols(points)
    laid = np.ascontiguousarray(laid.reshape(rows, width).T)
    whole = np.tile(np.arange(9, dtype=np.int8), (rows, 1))
    for column in laid:
        whole = MOVES[column[:, None], whole]
    state = np.zeros(rows, np.int8)
    for k in range(1, rows):
        state[k] = whole[k - 1, state[k - 1]]
    start = np.empty((width, rows), bool)
    for k, column in enumerate(laid):
        start[k] = STARTS[column, state]
        state = MOVES[column, state]
    return start.T.reshape(-1)[:n]


class Encoder:
    """Ids of pieces by ranked merging; ``ranks`` maps byte strings to ids."""

    def __init__(self, ranks: dict[bytes, int], cache_pieces: int = CACHE_PIECES):
        self.ranks = ranks
        self.cache: dict[str, tuple[int, ...]] = {}
        self.cache_pieces = cache_pieces

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Merge the neighbours of least rank until none can be merged, in n log n steps."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n = len(piece)
        ends = list(range(1, n + 1))  # end of the part that starts here; 0 when merged away
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(piece[i : i + 2])
            if rank is not None:
                heap.append((rank, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or middle >= stop or ends[middle] != stop:
                continue
            ends[i], ends[middle] = stop, 0
            if stop < n:
                before[stop] = i
                rank = ranks.get(piece[i : ends[stop]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ends[stop]))
            if before[i] >= 0:
                rank = ranks.get(piece[before[i] : stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, before[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return tuple(out)

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        """(ids, starts of pieces in code points) per text; both are empty for null and empty texts."""
        ids: list[list[int]] = []
        offsets: list[list[int]] = []
        begin = 0
        while begin < len(texts):
            stop, size = begin + 1, len(texts[begin] or "")
            while stop < len(texts) and size + len(texts[stop] or "") <= CHUNK_POINTS:
                size += len(texts[stop] or "")
                stop += 1
            self._encode_chunk([t or "" for t in texts[begin:stop]], ids, offsets)
            begin = stop
        return ids, offsets

    def _encode_chunk(self, texts, ids, offsets):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lengths + 1) - lengths - 1
        points = np.full(int(lengths.sum()) + len(texts), 0x110000, np.int32)
        inside = np.ones(len(points), bool)
        inside[first + lengths] = False
        joined = "".join(texts)
        points[inside] = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.int32)
        starts = np.flatnonzero(piece_starts(points))
        doc = np.searchsorted(first, starts, "right") - 1
        edge = points[starts] == 0x110000
        stops = np.append(starts[1:], len(points))[~edge]
        starts, doc = starts[~edge], doc[~edge]
        # positions in the joined text, which has no dividers
        low, high = (starts - doc).tolist(), (stops - doc).tolist()
        cache = self.cache
        if len(cache) > self.cache_pieces:
            cache.clear()
        pieces = [joined[a:b] for a, b in zip(low, high, strict=True)]
        for piece in set(pieces):
            if piece not in cache:
                cache[piece] = self.merge(piece.encode("utf-8", "surrogatepass"))
        found = [cache[p] for p in pieces]
        counts = np.searchsorted(doc, np.arange(len(texts) + 1))
        relative = (starts - first[doc]).tolist()
        for i in range(len(texts)):
            a, b = counts[i], counts[i + 1]
            ids.append([x for piece in found[a:b] for x in piece])
            offsets.append(relative[a:b])


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Ranks from lines of base64 and number."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


_ENCODERS: dict[int, Encoder] = {}


def _encoder(raw) -> Encoder:
    key = zlib.crc32(raw.value)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(raw.value))
    return _ENCODERS[key]


def ship_ranks(spark: SparkSession, path: str = RANKS_PATH):
    """The vocabulary file, about 1 MB whatever the corpus, sent once to every executor."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode_documents(documents: DataFrame, text: str = "text", path: str = RANKS_PATH, offsets: bool = False) -> DataFrame:
    """``documents`` without ``text``, with ``ids`` (array<int>) and, if asked, ``piece_starts``.

    Ids are those of the byte-level vocabulary without special tokens: marks such as
    ``<|endoftext|>`` inside a text are ordinary text.  Null and empty texts give an empty list.  Texts of
    any length are encoded whole.  ``piece_starts`` are offsets in code points.  Columns of ``documents``
    that are named like the new ones are replaced.
    """
    raw = ship_ranks(documents.sparkSession, path)
    kept = [c for c in documents.columns if c not in (text, "ids", "piece_starts")]
    names = [*kept, "ids", *(["piece_starts"] if offsets else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                piece = batch.slice(begin, 500)
                ids, starts = encoder.encode(piece.column(text).to_pylist())
                columns = [piece.column(c) for c in kept]
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                if offsets:
                    columns.append(pa.array(starts, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join(
        [
            *(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema),
            "ids array<int>",
            *(["piece_starts array<int>"] if offsets else []),
        ]
    )
    return documents.mapInArrow(run, schema)


def count_tokens(documents: DataFrame, text: str = "text", path: str = RANKS_PATH, name: str = "n_tokens") -> DataFrame:
    """``documents`` without ``text``, with the number of its tokens."""
    raw = ship_ranks(documents.sparkSession, path)
    kept = [c for c in documents.columns if c not in (text, name)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(raw)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                piece = batch.slice(begin, 500)
                ids, _ = encoder.encode(piece.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(c) for c in kept), pa.array([len(i) for i in ids], pa.int64())], [*kept, name]
                )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*kept).schema), f"{name} bigint"])
    return documents.mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, ids: str = "ids", path: str = RANKS_PATH) -> DataFrame:
    """``encoded`` without ``ids``, with the ``text`` that they stand for."""
    raw = ship_ranks(encoded.sparkSession, path)
    kept = [c for c in encoded.columns if c not in (ids, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {v: k for k, v in _encoder(raw).ranks.items()}
        for batch in batches:
            texts = [
                None if x is None else b"".join(names[i] for i in x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*kept).schema), "text string"])
    return encoded.mapInArrow(run, schema)
