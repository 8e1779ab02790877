"""Mixing sources to target shares of tokens, with capped repetition.

Texts are grouped by the set of sources they occur in, by one document of each; a source's further documents
of a text it holds are a group of their own, named by the source twice.  Tokens flow from these groups to the
sources' quotas; using a text again costs more each time, so repetition is spread as evenly and as late as the
quotas allow.  The flow is solved on group totals only; which documents carry it follows from a
seeded order within each group.  Whole documents leave a part of a quota open; it is filled with further uses of
documents that fit in.
"""

from __future__ import annotations

import warnings
from array import array
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tokens import RANKS_PATH, count_tokens

#: Hash ranges of a group in which running totals are taken one by one.
RANGES = 4096
#: Sets of sources above which a warning tells how many the driver solves; they are solved alike whatever their number.
MOST_GROUPS = 20_000


class Flow:
    """Greatest flow by levels and blocking flows (Dinic) between numbered nodes; edges may be widened and the flow sent on."""

    def __init__(self, nodes: int):
        self.ends, self.room, self.out = array("q"), array("q"), [array("q") for _ in range(nodes)]

    def edge(self, a: int, b: int, room: int) -> int:
        for x, y, r in ((a, b, room), (b, a, 0)):
            self.out[x].append(len(self.ends))
            self.ends.append(y)
            self.room.append(r)
        return len(self.ends) - 2

    def _levels(self, source: int, sink: int):
        level, queue = array("q", [-1]) * len(self.out), deque([source])
        level[source] = 0
        while queue:
            x = queue.popleft()
            for e in self.out[x]:
                if self.room[e] > 0 and level[self.ends[e]] < 0:
                    level[self.ends[e]] = level[x] + 1
                    queue.append(self.ends[e])
        return level if level[sink] >= 0 else None

    def send(self, source: int, sink: int) -> int:
        """Send as much more as possible; the amount."""
        sent = 0
        while (level := self._levels(source, sink)) is not None:
            left = array("q", [0]) * len(self.out)
            path: list[int] = []
            x = source
            while True:
                if x == sink:
                    amount = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= amount
                        self.room[e ^ 1] += amount
                    sent += amount
                    path, x = [], source
                    continue
                edges = self.out[x]
                while left[x] < len(edges):
                    e = edges[left[x]]
                    if self.room[e] > 0 and level[self.ends[e]] == level[x] + 1:
                        break
                    left[x] += 1
                else:
                    if x == source:
                        break
                    x = self.ends[path.pop() ^ 1]
                    left[x] += 1
                    continue
                path.append(e)
                x = self.ends[e]
        return sent


def supply_of(groups: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Tokens that each source can give with every use of its documents."""
    out = dict.fromkeys(targets, 0)
    for group, tokens in groups.items():
        for source in dict.fromkeys(group):
            if source in targets:
                out[source] += tokens * targets[source][1]
    return out


def solve(groups: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None) -> tuple[int, dict]:
    """(total, {(group, source): tokens}) where groups hold tokens by set of sources, each of which has a document of
    its own for every text.

    targets: source -> (share, most uses of a document).  Without ``total`` it is the largest at which every
    source that has any token gets its share.  Where a quota can't be filled, what there is flows.

    The k-th use of a group costs more than the one before, and of groups of several documents a text a little more
    still.  Costs lie on the edges into groups only; of such a flow the cheapest is found by letting the edges in by cost,
    since what is once sent through one stays sent.
    """
    supply = supply_of(groups, targets)
    if total is None:
        bounds = []
        for source, (share, _) in targets.items():
            if share > 0 and supply[source] > 0:
                # the greatest size of which the share, in whole tokens, is within the supply
                size = int((supply[source] + 1) / share) + 1
                while int(share * size) > supply[source]:
                    size -= 1
                bounds.append(size)
        total = min(bounds, default=0)
    start, end = 0, 1
    nodes = {source: 2 + i for i, source in enumerate(targets)}
    flow, arcs, entries = Flow(2 + len(targets) + len(groups)), {}, {}
    for source, (share, _) in targets.items():
        flow.edge(nodes[source], end, int(share * total))
    uses = {}
    for node, (group, tokens) in enumerate(groups.items(), 2 + len(targets)):
        members = [s for s in dict.fromkeys(group) if s in targets]
        if not members or not tokens:
            continue
        entries[group] = flow.edge(start, node, 0)
        uses[group] = sum(targets[s][1] for s in members)
        for s in members:
            arcs[group, s] = flow.edge(node, nodes[s], tokens * targets[s][1])
    for use in range(max(uses.values(), default=0)):
        for several in (False, True):
            opened = [g for g in entries if uses[g] > use and (len(g) > 1) == several]
            for group in opened:
                flow.room[entries[group]] += groups[group]
            if opened:
                flow.send(start, end)
    return total, {k: flow.room[e ^ 1] for k, e in arcs.items() if flow.room[e ^ 1] > 0}


def measured_texts(documents: DataFrame, path: str = RANKS_PATH) -> DataFrame:
    """(text_key, n_tokens, held, again): each distinct text once, with its sources and the least doc_id in each; then,
    marked ``again``, every further document of a text in a source by itself.

    Texts without tokens and documents without source take no part.
    """
    rows = documents.where("source is not null and text is not null").select("doc_id", "source", F.md5("text").alias("text_key"), "text")
    counted = cut_lineage(count_tokens(rows, path=path).where("n_tokens > 0").select("doc_id", "source", "text_key", "n_tokens").distinct())
    first = counted.groupBy("text_key", "source").agg(F.min("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"))
    texts = first.groupBy("text_key").agg(F.max("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("held"))
    further = counted.join(first.select("text_key", "source", F.col("doc_id").alias("least")), ["text_key", "source"]).where("doc_id > least")
    more = further.select("text_key", "n_tokens", F.array(F.struct("source", "doc_id")).alias("held"))
    return texts.withColumn("again", F.lit(False)).unionByName(more.withColumn("again", F.lit(True)))


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, path: str = RANKS_PATH) -> tuple[DataFrame, int]:
    """(rows of doc_id, source, n_uses, n_tokens; the total aimed at).

    ``n_tokens`` are those of one use.  Every document counts, also one with the text of another; first uses of
    texts come before those of further documents with the same text.  No document is
    used more often than its source allows.  What a source gets differs from its quota by less than its
    shortest document that could be used once more.  The targets are a fixed list; of the corpus only totals per group of
    texts, and per source numbers of documents by length, reach the driver.
    """
    wanted = {
        r["source"]: (float(r["target_share"] or 0.0), int(r["max_repeats"] or 0))
        for r in targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).limit(10_001).collect()
    }
    if len(wanted) > 10_000:
        raise ValueError("mix targets must be a list of at most 10,000 sources")
    texts = measured_texts(documents, path)
    names = F.array(*[F.lit(s) for s in sorted(wanted)]) if wanted else F.array().cast("array<string>")
    texts = texts.withColumn("held", F.filter("held", lambda x: F.array_contains(names, x["source"]))).where(F.size("held") > 0)
    texts = cut_lineage(
        texts.withColumn("grp", F.array_join(F.transform(F.when(F.col("again"), F.concat("held", "held")).otherwise(F.col("held")), lambda x: x["source"]), "\u0001"))
        .withColumn("__h", F.when(F.col("again"), F.xxhash64("text_key", F.lit(seed), F.col("held")[0]["doc_id"])).otherwise(F.xxhash64("text_key", F.lit(seed))))
        .withColumn("__range", F.pmod(F.shiftright("__h", 20), F.lit(RANGES)).cast("int"))
    )
    ranges = texts.groupBy("grp", "__range").agg(F.sum("n_tokens").alias("tokens"))
    sizes = ranges.groupBy("grp").agg(F.sum("tokens").alias("tokens")).collect()
    if len(sizes) > MOST_GROUPS:
        warnings.warn(f"{len(sizes)} sets of sources are solved on the driver", stacklevel=2)
    # in order, so that the flow does not depend on how the sets arrive
    groups = {tuple(grp.split("\u0001")): int(tokens) for grp, tokens in sorted(map(tuple, sizes))}
    total, flows = solve(groups, wanted, total_tokens)

    arcs = []
    for group, tokens in groups.items():
        low = 0
        for source in dict.fromkeys(group):
            amount = flows.get((group, source), 0)
            if amount:
                arcs.append(("\u0001".join(group), source, tokens, low, low + amount))
                low += amount
    spark = documents.sparkSession
    plan = spark.createDataFrame(arcs, "grp string, source string, width bigint, low bigint, high bigint")
    # where each text stands in its group's order: totals of the ranges before it, then of the texts before it
    before = ranges.withColumn(
        "base", F.coalesce(F.sum("tokens").over(Window.partitionBy("grp").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("tokens")
    within = Window.partitionBy("grp", "__range").orderBy("__h", "text_key", "held").rowsBetween(Window.unboundedPreceding, -1)
    placed = texts.join(before, ["grp", "__range"]).withColumn("at", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    # uses that lie wholly within what flows
    at, n, width = F.col("at"), F.col("n_tokens"), F.col("width")
    uses = F.floor((F.col("high") - n - at) / width) - F.ceil((F.col("low") - at) / width) + 1
    most = F.lit(None).cast("int")
    for source, (_, times) in wanted.items():
        most = F.when(F.col("source") == source, F.lit(times)).otherwise(most)
    held = cut_lineage(
        placed.select("grp", "n_tokens", "at", "__h", "again", F.inline("held"))
        .join(plan, ["grp", "source"], "left")
        .select("doc_id", "source", "n_tokens", "__h", "again", F.greatest(F.lit(0), F.coalesce(uses, F.lit(0))).cast("int").alias("n_uses"), most.alias("most"))
    )
    taken = {r["source"]: int(r["tokens"]) for r in held.groupBy("source").agg(F.sum(F.col("n_uses") * F.col("n_tokens")).alias("tokens")).collect()}
    gaps = {s: int(share * total) - taken.get(s, 0) for s, (share, _) in wanted.items() if s in taken}
    more = _fill(held, {s: g for s, g in gaps.items() if g > 0})
    rows = held.join(more, ["doc_id", "source"], "left").withColumn("n_uses", F.col("n_uses") + F.coalesce("extra", F.lit(0)))
    return rows.where("n_uses > 0").select("doc_id", "source", "n_uses", "n_tokens"), total


def lengths_to_fill(counts: dict[str, dict[int, int]], gaps: dict[str, int]) -> dict[tuple[str, int], int]:
    """How many documents of which length fill what is open of each source: the longest that fit in, as many as there
    are, then shorter ones, and at last the shortest one left if it comes nearer although it passes the quota."""
    out: dict[tuple[str, int], int] = {}
    for source, gap in gaps.items():
        left = dict(counts.get(source, {}))
        for length in sorted(left, reverse=True):
            times = min(left[length], gap // length)
            if times:
                out[source, length] = times
                left[length] -= times
                gap -= times * length
        rest = [length for length, n in left.items() if n > 0]
        if rest and min(rest) < 2 * gap:
            out[source, min(rest)] = out.get((source, min(rest)), 0) + 1
    return out


def _firsts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every source and length the first ``times`` rows of a partition."""
    kept: dict = {}
    for frame in frames:
        for key, part in frame.groupby(["source", "n_tokens"]):
            both = pd.concat([kept[key], part]) if key in kept else part
            kept[key] = both.sort_values(ORDER).head(int(both["times"].iloc[0]))
    for part in kept.values():
        yield part


#: Which of several documents of one length is used once more: the least used, a text before further documents of it.
ORDER = ["n_uses", "again", "__h", "doc_id"]


def _fill(held: DataFrame, gaps: dict[str, int]) -> DataFrame:
    """(doc_id, source, extra): documents to be used once more to fill what is open of each source.

    Numbers of documents by length reach the driver, none longer than two gaps, which are a few documents wide.
    """
    gap = F.lit(0)
    for source, size in gaps.items():
        gap = F.when(F.col("source") == source, F.lit(size)).otherwise(gap)
    fitting = held.where((F.col("n_uses") < F.col("most")) & (F.col("n_tokens") < 2 * gap))
    counts: dict[str, dict[int, int]] = {}
    for row in fitting.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).collect():
        counts.setdefault(row["source"], {})[int(row["n_tokens"])] = row["n"]
    wanted = held.sparkSession.createDataFrame([(s, n, m) for (s, n), m in lengths_to_fill(counts, gaps).items()], "source string, n_tokens bigint, times int")
    columns = "doc_id bigint, source string, n_tokens bigint, times int, n_uses int, again boolean, __h bigint"
    names = [c.split()[0] for c in columns.split(", ")]
    some = fitting.join(wanted, ["source", "n_tokens"]).select(*names).mapInPandas(_firsts, columns)
    place = F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy(*ORDER))
    return some.withColumn("place", place).where("place <= times").select("doc_id", "source", F.lit(1).alias("extra"))


def mix_report(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, path: str = RANKS_PATH) -> DataFrame:
    """Per target source: documents, uses and tokens taken, the share reached and whether the target is met.

    A target counts as met within one thousandth.  Sources without documents come out with 0.
    """
    rows, total = mix(documents, targets, total_tokens, seed, path)
    taken = rows.groupBy("source").agg(
        F.count("*").alias("n_documents"), F.sum("n_uses").alias("n_uses"), F.sum(F.col("n_uses") * F.col("n_tokens")).alias("n_tokens"), F.max("n_uses").alias("most_uses")
    )
    joined = targets.select("source", "target_share", "max_repeats").distinct().join(taken, "source", "left").na.fill(0, ["n_documents", "n_uses", "n_tokens", "most_uses"])
    # one row per target source, so one window over all of them is small
    share = F.try_divide(F.col("n_tokens"), F.sum("n_tokens").over(Window.partitionBy(F.lit(0))))
    return joined.withColumn("share", share).select(
        "source",
        "target_share",
        "max_repeats",
        "n_documents",
        "n_uses",
        "n_tokens",
        "most_uses",
        F.round("share", 6).alias("reached_share"),
        F.coalesce(F.abs(F.col("share") - F.col("target_share")) <= 0.001, F.lit(False)).alias("met"),
        F.lit(total).cast("long").alias("total_aimed"),
    )
