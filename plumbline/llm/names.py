"""Variant spellings of names typed by people, linked by merging and matching again.

Spellings that certainly belong together (the same identifier, or the same words in any order, case
and punctuation with the same context) are merged first.  A merged record is a profile: the union of its
spellings, with their words, initials, phase and context.  Profiles enter blocking again, are compared,
and are merged where they agree, until a round merges nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import CUT_MARKS, NUMBER_WORDS, is_filler
from ..operators.link import connected_components
from ..session import cut_lineage


def roman(number: int) -> str:
    """A number below 40 as a lower-case roman numeral."""
    out = "x" * (number // 10)
    for value, sign in ((9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        while number % 10 >= value:
            out, number = out + sign, number - value
    return out


#: Words for what a name names, with short forms; they tell little and come first in no comparison.
KIND_WORDS = {
    "project": "p", "proj": "p", "prj": "p", "prjct": "p", "programme": "p", "program": "p", "prog": "p", "pgm": "p", "prgm": "p",
    "scheme": "s", "sch": "s", "schm": "s", "delivery": "d", "deliv": "d", "del": "d", "upgrade": "u", "upgr": "u",
}
LONG_KINDS = ("project", "programme", "scheme", "delivery", "upgrade")
KIND_INITIALS = ("", "p", "s", "dp", "up")
STOP_WORDS = ("for", "at", "the", "of", "and", "in", "a")
#: Numbers of phases as words and as roman numerals.
COUNTS = {word: i for i, word in enumerate(NUMBER_WORDS[:10], 1)} | {roman(i): i for i in range(1, 11)}
#: Rounds of merging and matching after which an error is raised; two or three are usual, a chain of n entities may take n.
ROUNDS = 200


@lru_cache(maxsize=200_000)
def near(a: str, b: str) -> bool:
    """Equal, or for words of four letters or more one insertion, deletion, substitution or swap apart."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(a) < 4 or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i:] == b[i + 1 :]


def short_for(a: str, b: str) -> bool:
    """Whether ``a`` is a short form of ``b``: its beginning, or its letters with some left out inside."""
    if len(a) >= len(b):
        return False
    if len(a) >= 3 and b.startswith(a):
        return True
    if len(a) < 5 or a[0] != b[0] or a[-1] != b[-1] or len(a) < 0.7 * len(b):
        return False
    rest = iter(b)
    return all(c in rest for c in a)


def same_word(a: str, b: str) -> bool:
    return near(a, b) or short_for(a, b) or short_for(b, a)


def parse_name(name: str) -> tuple[list[str], int | None, bool, bool]:
    """(telling words, phase, whether a kind word is there, whether the text is cut off)."""
    text = unicodedata.normalize("NFKC", name)
    cut = bool(re.search("(?i)" + CUT_MARKS, text))
    text = re.sub("(?i)" + CUT_MARKS, " ", text).lower().replace("&", " and ").replace("'", "")
    inside = [w for part in re.findall(r"[(\[]([^)\]]*)", text) for w in re.findall(r"[^\W_]+", part)]
    words = re.findall(r"[^\W_]+", text)
    phase, kept, i = None, [], 0
    while i < len(words):
        word = words[i]
        following = words[i + 1] if i + 1 < len(words) else ""
        glued = re.fullmatch(r"(?:phase|ph)(\d{1,2}|[ivx]{1,4})", word)
        if glued and (glued[1].isdigit() or glued[1] in COUNTS):
            phase = COUNTS.get(glued[1]) or int(glued[1])
        elif (word == "ph" or near(word, "phase")) and (following in COUNTS or re.fullmatch(r"\d{1,2}", following)):
            phase = COUNTS.get(following) or int(following)
            i += 1
        elif word not in ("ph", "phase"):
            kept.append(word)
        i += 1
    letters = "".join(w[0] for w in kept if w not in inside and w not in STOP_WORDS)
    kept = [w for w in kept if not (w in inside and len(w) > 1 and (w == letters or w == letters[1:]))]
    has_kind = any(w in KIND_WORDS or any(near(w, k) for k in LONG_KINDS) for w in kept)
    telling = [w for w in kept if w not in KIND_WORDS and w not in STOP_WORDS and not any(near(w, k) for k in LONG_KINDS)]
    # a name that breaks off inside its kind word
    if len(telling) > 3 and telling[-1] == kept[-1] and any(k.startswith(telling[-1]) for k in LONG_KINDS):
        telling, has_kind, cut = telling[:-1], True, True
    return telling or kept, phase, has_kind, cut


def _aligned(a: list[str], b: list[str], cut: bool) -> bool:
    """Whether every word of ``a`` has a partner of its own in ``b``; of a cut text the last may be any beginning."""
    left = list(b)
    for k, word in enumerate(a):
        for other in left:
            if same_word(word, other) or (cut and k == len(a) - 1 and other.startswith(word)):
                left.remove(other)
                break
        else:
            for x in range(len(left) - 1):
                if near(word, left[x] + left[x + 1]):
                    del left[x : x + 2]
                    break
            else:
                return False
    return True


def compare(a: dict, b: dict) -> int:
    """How two spellings agree: 3 by their words, 2 by initials, 1 only by place and context, 0 not at all.

    A spelling has words, phase, has_kind, and alien: the words that never stand beside a kind word.  One
    without a kind word may be cut off, so its last word may be any beginning.
    """
    if a["phase"] is not None and b["phase"] is not None and a["phase"] != b["phase"]:
        return 0
    wa, wb = list(a["words"]), list(b["words"])
    if len(wa) > len(wb):
        a, b, wa, wb = b, a, wb, wa
    shared = [(x, y) for x in wa for y in wb if len(x) >= 5 and same_word(x, y)]
    if not shared:
        return 3 if len(wa) > 1 and near("".join(wa), "".join(wb)) else 0
    if len(wa) >= 2 and (_aligned(wa, wb, not a["has_kind"]) or _aligned(wb, wa, not b["has_kind"])):
        return 3
    for x, y in shared:
        ra, rb = [w for w in wa if w != x], [w for w in wb if w != y]
        for single, full in ((ra, rb), (rb, ra)):
            if len(single) == 1 and len(full) >= 2 and 2 <= len(single[0]) <= 7:
                initials = "".join(w[0] for w in full)
                if single[0] in {p + initials + k for p in ("", x[0]) for k in KIND_INITIALS}:
                    return 2
    # a full name states its phase, so by place alone it can't be that of a name with another
    if a["phase"] != b["phase"] and ((a["phase"] is None and a["has_kind"]) or (b["phase"] is None and b["has_kind"])):
        return 0
    for x, y in shared:
        ra, rb = [w for w in wa if w != x], [w for w in wb if w != y]
        if all(w in a["alien"] for w in ra) or all(w in b["alien"] for w in rb):
            return 1
    return 0


def _parse_frame(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        parsed = [parse_name(n) for n in frame["name"]]
        yield frame.assign(
            words=[p[0] for p in parsed], phase=pd.array([p[1] for p in parsed], "Int32"), has_kind=[p[2] for p in parsed], cut=[p[3] for p in parsed]
        )


def spellings(panel: DataFrame) -> DataFrame:
    """One row per distinct usable spelling with its context: identifier, start date and publishing body.

    A spelling stands for one project, so its context is any one of its rows'.
    """
    body = F.regexp_extract("publication_slug", r"^[a-z]+-([a-z]+)-", 1)
    rows = panel.where(~is_filler(F.col("project_name")))
    return rows.groupBy(F.col("project_name").alias("name")).agg(
        F.max("portfolio_id").alias("pid"), F.max("start_date").alias("start"), F.max(F.when(body != "", body)).alias("body")
    )


def link_projects(panel: DataFrame) -> DataFrame:
    """(name, entity, pid): every usable spelling of project_name with the class of spellings it belongs to,
    and the identifier that it was seen with.

    Two classes with different identifiers, or with spellings of different phases, are never merged.
    Fillers and nulls are no spellings; a cut-off name is one.  Spellings without any context are
    matched by two words or by initials, never by place alone.
    """
    known = _certain(cut_lineage(_with_frequencies(spellings(panel))))
    return _merged(known, _match).select("name", "entity", "pid")


def _merged(known: DataFrame, match) -> DataFrame:
    """``known`` with entities merged as ``match`` says, profile against profile, until it says nothing more."""
    for _ in range(ROUNDS):
        moves = match(known)
        if moves is None:
            return known
        known = cut_lineage(
            known.join(moves, "entity", "left").withColumn("entity", F.coalesce("to", "entity")).drop("to")
        )
    raise RuntimeError(f"linking still merges after {ROUNDS} rounds")


def _with_frequencies(names: DataFrame) -> DataFrame:
    """Spellings parsed, with how many spellings have each word and which words never stand beside a kind word."""
    parsed = names.withColumn("sid", F.xxhash64("name")).mapInPandas(
        _parse_frame,
        "name string, pid string, start date, body string, sid bigint, words array<string>, phase int, has_kind boolean, cut boolean",
    )
    parsed = cut_lineage(parsed)
    each = parsed.select("sid", "has_kind", F.explode(F.array_distinct("words")).alias("word"))
    counts = each.groupBy("word").agg(F.count("*").alias("df"), F.count_if("has_kind").alias("kinds"))
    back = (
        each.join(counts, "word")
        .groupBy("sid")
        .agg(
            F.sort_array(F.collect_list(F.struct("df", "word"))).alias("rare"),
            F.collect_set(F.when((F.col("kinds") - F.col("has_kind").cast("int")) < 1, F.col("word"))).alias("alien"),
        )
    )
    return parsed.join(back, "sid", "left").withColumn("rare", F.col("rare.word"))


def _certain(known: DataFrame) -> DataFrame:
    """``known`` with entity, after merging by identifier and by equal words in equal context."""
    words = F.concat_ws(" ", F.array_sort("words"))
    telling = F.concat_ws("|", F.lit("key"), F.coalesce("body", F.lit("")), F.col("start").cast("string"), F.coalesce(F.col("phase").cast("string"), F.lit("")), words)
    keys = F.array_compact(
        F.array(
            F.when(F.col("pid").isNotNull(), F.xxhash64(F.concat(F.lit("id|"), F.col("pid")))),
            F.when(F.col("start").isNotNull() & (F.size("words") >= 3), F.xxhash64(telling)),
            F.col("sid"),
        )
    )
    joined = connected_components(known.select("sid", F.explode(keys).alias("key")), "sid", "key")
    return cut_lineage(known.join(joined, F.col("sid") == F.col("node")).drop("node").withColumnRenamed("component", "entity"))


def _block_keys(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, key) of close blocks: context and the head or tail of a word; and (entity, undated, key) of loose
    blocks: body with the heads of two words, or with the head of one and the initials of the others."""
    words = F.array_distinct(F.flatten(F.transform("spellings", lambda s: s["rare"])))
    close = profile.where("start is not null").select(
        "entity",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        words,
                        lambda w: F.array(
                            F.xxhash64(F.lit("head"), F.col("start"), F.col("body"), F.substring(w, 1, 4)),
                            F.xxhash64(F.lit("tail"), F.col("start"), F.col("body"), F.substring(w, F.lit(-4), F.lit(4))),
                        ),
                    )
                )
            )
        ).alias("key"),
    )

    def pairs(s):
        return F.flatten(
            F.transform(
                s["words"],
                lambda x: F.transform(F.filter(s["words"], lambda y: y > x), lambda y: F.xxhash64(F.lit("two"), F.col("body"), F.substring(x, 1, 4), F.substring(y, 1, 4))),
            )
        )

    def initials(s):
        """Place and first letters: of a name of three words, or of one word and a short one."""
        others = lambda x: F.filter(s["words"], lambda y: y != x)
        key = lambda x, letters: F.xxhash64(F.lit("ini"), F.col("body"), F.substring(x, 1, 4), letters)
        full = F.transform(s["words"], lambda x: key(x, F.array_join(F.transform(others(x), lambda y: F.substring(y, 1, 1)), "")))
        short = lambda at: F.transform(s["words"], lambda x: key(x, F.substring(F.array_join(others(x), ""), at, 2)))
        return F.when(F.size(s["words"]) == 3, full).when(F.size(s["words"]) == 2, F.concat(short(1), short(2))).otherwise(F.array().cast("array<bigint>"))

    keys = F.concat(F.flatten(F.transform("spellings", pairs)), F.flatten(F.transform("spellings", initials)))
    loose = profile.select("entity", F.col("start").isNull().alias("undated"), F.explode(F.array_distinct(keys)).alias("key"))
    return close, loose


def _score_frame(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        scores = []
        for left, right, both in zip(frame["a_spellings"], frame["b_spellings"], frame["dated"], strict=True):
            mine, theirs = {s["phase"] for s in left if s["phase"] is not None}, {s["phase"] for s in right if s["phase"] is not None}
            if mine and theirs and not mine & theirs:
                scores.append(0)
                continue
            best = max((compare(x, y) for x in left for y in right), default=0)
            scores.append(best if both or best > 1 else 0)
        yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "a_pid": frame["a_pid"], "b_pid": frame["b_pid"], "score": scores})


def _match(known: DataFrame) -> DataFrame | None:
    """(entity, to): where entities that agree move, each with its best partners only; None when nothing moves.

    A chain of partners takes several rounds, since an entity moves one step at a time to the lesser one.  What
    agrees by place and context only, with several entities, waits until these have become one.
    """
    profile = cut_lineage(
        known.groupBy("entity").agg(
            F.max("pid").alias("pid"), F.max("start").alias("start"), F.max("body").alias("body"), F.collect_set(F.struct("words", "phase", "has_kind", "alien", "rare")).alias("spellings")
        )
    )
    close, loose = _block_keys(profile)
    near_by = close.select(F.col("entity").alias("a"), "key").join(close.select(F.col("entity").alias("b"), "key"), "key").where("a < b").select("a", "b")
    far = (
        loose.where("undated").select(F.col("entity").alias("a"), "key").join(loose.select(F.col("entity").alias("b"), "key"), "key").where("a <> b")
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    candidates = near_by.unionByName(far).distinct()
    left_side = profile.select(*[F.col(c).alias(f"a_{c}") for c in profile.columns])
    right_side = profile.select(*[F.col(c).alias(f"b_{c}") for c in profile.columns])
    possible = (
        candidates.join(left_side, F.col("a") == F.col("a_entity"))
        .join(right_side, F.col("b") == F.col("b_entity"))
        .where("(a_pid is null or b_pid is null or a_pid = b_pid) and (a_start is null or b_start is null or a_start = b_start)")
    )
    scored = possible.select(
        "a", "b", "a_pid", "b_pid", "a_spellings", "b_spellings", F.expr("a_start is not null and b_start is not null").alias("dated")
    ).mapInPandas(_score_frame, "a bigint, b bigint, a_pid string, b_pid string, score int")
    good = cut_lineage(scored.where("score > 0"))
    if good.isEmpty():
        return None
    # an entity without identifier may go with one identifier only: that of its best partners
    sides = F.array(
        F.struct(F.col("a").alias("entity"), F.col("b").alias("other"), F.col("a_pid").alias("own"), F.col("b_pid").alias("to_pid")),
        F.struct(F.col("b").alias("entity"), F.col("a").alias("other"), F.col("b_pid").alias("own"), F.col("a_pid").alias("to_pid")),
    )
    sided = good.select("a", "b", "score", F.inline(sides))
    mine = Window.partitionBy("entity")
    topped = sided.withColumn("top", F.max("score").over(mine)).where("score = top")
    settled = (
        topped.withColumn("least_pid", F.min("to_pid").over(mine))
        .withColumn("most_pid", F.max("to_pid").over(mine))
        .withColumn("partners", F.count("*").over(mine))
        .where("(own is not null or least_pid is null or least_pid = most_pid) and (score > 1 or partners = 1)")
    )
    agreed = settled.groupBy("a", "b").agg(F.count("*").alias("sides")).where("sides = 2")
    moves = cut_lineage(agreed.groupBy(F.col("b").alias("entity")).agg(F.min("a").alias("to")))
    return None if moves.isEmpty() else moves


#: Words for what a department is, which tell little of which one it is.
DEPARTMENT_KINDS = ("department", "dept", "dpt", "ministry", "min", "office", "off", "authority", "auth", "agency", "agcy")
#: A spelling that only its body tells is a nickname, and may go with the body's commonest department, when it has at
#: most this share of that department's rows.
NICKNAME_SHARE = 0.25


def parse_department(name: str) -> tuple[list[str], list[str]]:
    """(all words, telling words); bracketed initials of the other words are left out."""
    text = unicodedata.normalize("NFKC", name).lower().replace("&", " and ").replace("'", "").replace("’", "")
    words = re.findall(r"[^\W_]+", text)
    inside = {w for part in re.findall(r"[(\[]([^)\]]*)", text) for w in re.findall(r"[^\W_]+", part)}
    others = [w for w in words if w not in inside]
    words = [w for w in words if w not in inside or not spells_initials(w, others)]
    long_kinds = [k for k in DEPARTMENT_KINDS if len(k) > 4]
    telling = [w for w in words if w not in STOP_WORDS and w not in DEPARTMENT_KINDS and not any(near(w, k) for k in long_kinds)]
    return words, telling or words


def spells_initials(short: str, words: list[str]) -> bool:
    """Whether a word consists of the first letters of ``words`` in order; those of small words may be left out."""
    at = {0}
    for word in words:
        step = {i + 1 for i in at if i < len(short) and short[i] == word[0]}
        at = step | at if word in STOP_WORDS else step
    return len(words) > 1 and len(short) in at


def compare_departments(a: dict, b: dict) -> int:
    """How two spellings of departments agree: 3 by their telling words, 2 by initials, 0 not at all.

    Within one body the words of the shorter may be some of the other's; else all must have a partner, and two
    words of four letters or more are wanted.
    """
    ta, tb = list(a["telling"]), list(b["telling"])
    if len(ta) > len(tb):
        a, b, ta, tb = b, a, tb, ta
    same_body = a["body"] is not None and a["body"] == b["body"]
    if same_body:
        for short, full in ((a, b), (b, a)):
            if len(short["words"]) == 1 and spells_initials(short["words"][0], list(full["words"])):
                return 2
    long = [w for w in ta if len(w) >= 4]
    if not long or not _aligned(ta, tb, False):
        return 0
    if same_body:
        return 3
    return 3 if len(long) >= 2 and _aligned(tb, ta, False) else 0


def _parse_departments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        parsed = [parse_department(n) for n in frame["name"]]
        yield frame.assign(words=[p[0] for p in parsed], telling=[p[1] for p in parsed])


def department_spellings(panel: DataFrame) -> DataFrame:
    """(name, body, n, sid, words, telling): one row per distinct usable spelling of department, with the body in whose
    publications most of its rows stand (the least at a tie)."""
    body = F.nullif(F.regexp_extract("publication_slug", r"^[a-z]+-([a-z]+)-", 1), F.lit(""))
    counts = panel.where(~is_filler(F.col("department"))).groupBy(F.col("department").alias("name"), body.alias("body")).agg(F.count("*").alias("n"))
    first = F.when(F.col("body").isNotNull(), F.struct(-F.col("n"), F.col("body")))
    names = counts.groupBy("name").agg(F.min_by("body", first).alias("body"), F.sum("n").alias("n")).withColumn("sid", F.xxhash64("name"))
    return names.mapInPandas(_parse_departments, "name string, body string, n bigint, sid bigint, words array<string>, telling array<string>")


def link_departments(panel: DataFrame) -> DataFrame:
    """(name, entity) for every usable spelling of department, by the same merging and matching as of projects.

    Spellings with the same letters, or the same telling words in the same body, are merged first.  Profiles then
    block by body and the beginning of a telling word, by body and a first letter for initials, and, where a body isn't
    known, by the beginning alone; what agrees is merged, and matching begins again until nothing moves.  Then a
    nickname, whose spellings have one telling word and few rows, goes with the commonest department of its body.  Two departments
    of one body whose words differ stay apart.
    """
    known = cut_lineage(department_spellings(panel))
    letters = F.xxhash64(F.lit("letters"), F.regexp_replace(F.lower("name"), r"[^\p{L}\p{N}]+", ""))
    equal = F.when(F.col("body").isNotNull(), F.xxhash64(F.lit("words"), F.col("body"), F.concat_ws(" ", F.array_sort("telling"))))
    keys = F.array_compact(F.array(letters, equal, F.col("sid")))
    joined = connected_components(known.select("sid", F.explode(keys).alias("key")), "sid", "key")
    known = cut_lineage(known.join(joined, F.col("sid") == F.col("node")).drop("node").withColumnRenamed("component", "entity"))
    return _merged(known, _match_departments).select("name", "entity")


def _match_departments(known: DataFrame) -> DataFrame | None:
    """(entity, to): where departments that agree move; None when nothing moves."""
    spelling = F.struct("words", "telling", "body")
    profile = cut_lineage(
        known.groupBy("entity").agg(F.collect_set("body").alias("bodies"), F.sum("n").alias("n"), F.collect_set(spelling).alias("spellings"), F.max(F.size("telling")).alias("most"))
    )
    heads = F.array_distinct(F.flatten(F.transform("spellings", lambda s: F.transform(s["telling"], lambda w: F.substring(w, 1, 4)))))
    blocks = F.when(F.size("bodies") > 0, F.col("bodies")).otherwise(F.array(F.lit("")))
    worded = profile.select("entity", F.size("bodies").alias("nb"), F.explode(heads).alias("head"), F.col("bodies")).select("entity", "nb", "head", F.explode_outer("bodies").alias("body"))
    left, right = (worded.select(F.col("entity").alias(x), F.col("head"), F.col("body").alias(f"{x}_body")) for x in ("a", "b"))
    within = left.join(right, (left["head"] == right["head"]) & (left["a_body"] == right["b_body"])).where("a < b").select("a", "b")
    unknown = worded.where("nb = 0").select(F.col("entity").alias("u"), "head")
    loose = unknown.join(worded.select(F.col("entity").alias("v"), "head"), "head").where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    # names of one word against longer names by body and first letter
    first = F.array_distinct(F.transform("spellings", lambda s: F.named_struct(F.lit("single"), F.size(s["words"]) == 1, F.lit("letter"), F.substring(F.get(s["words"], 0), 1, 1))))
    lettered = profile.select("entity", F.explode(blocks).alias("body"), first.alias("f")).where("body <> ''").select("entity", "body", F.inline("f"))
    single = lettered.where("single").select(F.col("entity").alias("u"), "body", "letter")
    full = lettered.where("not single").select(F.col("entity").alias("v"), "body", "letter")
    spoken = single.join(full, ["body", "letter"]).where("u <> v").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    candidates = within.unionByName(loose).unionByName(spoken).distinct()
    sides = [profile.select(F.col("entity").alias(x), F.col("spellings").alias(f"{x}_spellings")) for x in ("a", "b")]
    scored = candidates.join(sides[0], "a").join(sides[1], "b").mapInPandas(_score_departments, "a bigint, b bigint, score int")
    moves = cut_lineage(scored.where("score > 0").groupBy(F.col("b").alias("entity")).agg(F.min("a").alias("to")))
    if not moves.isEmpty():
        return moves
    # what only its body tells: a few rows beside the body's commonest department
    one = profile.where(F.size("bodies") == 1).withColumn("body", F.get("bodies", 0))
    main = one.groupBy("body").agg(F.max_by("entity", F.struct("n", "entity")).alias("main"), F.max("n").alias("main_n"))
    nicknames = one.join(main, "body").where((F.col("entity") != F.col("main")) & (F.col("most") <= 1) & (F.col("n") <= NICKNAME_SHARE * F.col("main_n")))
    moves = cut_lineage(nicknames.select("entity", F.col("main").alias("to")))
    return None if moves.isEmpty() else moves


def _score_departments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        scores = [max((compare_departments(x, y) for x in left for y in right), default=0) for left, right in zip(frame["a_spellings"], frame["b_spellings"], strict=True)]
        yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "score": scores})


def spelling_pairs(linked: DataFrame, field: str) -> DataFrame:
    """(field_name, spelling_a, spelling_b): each pair of different spellings of one entity, the smaller by bytes first.

    The pairs are what the result is to be; a class holds the distinct spellings of one entity only.
    """
    other = linked.select(F.col("name").alias("spelling_b"), "entity")
    return (
        linked.select(F.col("name").alias("spelling_a"), "entity")
        .join(other, "entity")
        .where("spelling_a < spelling_b")
        .select(F.lit(field).alias("field_name"), "spelling_a", "spelling_b")
    )
