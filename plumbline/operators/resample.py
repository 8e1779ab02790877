"""Seeded permutations and bootstraps whose order comes from md5, so every engine draws alike.

A permutation sends the rows of a block once to every task that makes some of its draws, and orders them there; draw keys are
never shuffled.  In a block too large for that, positions come from counts per range of the draw key and from the order within
one range, so it is spread over RANGES tasks.  Both ways give the same order.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .scoring import weighted_pearson

#: Rows of a block up to which a task holds it; larger ones are dealt by ranges.
BLOCK_ROWS = 2_000_000
#: Draws of a block that one task makes.
DRAWS_A_TASK = 20


def draw_key(ident: Column, seed: Column | int) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat(ident.cast("string"), F.lit("#"), seed.cast("string")))


#: Ranges of a draw key: its first three hex digits.
RANGES = 4096


def positions(rows: DataFrame, by: list[str], key: str, tie: str, out: str) -> DataFrame:
    """Rows with their place (from 1) in the order of the hex string ``key``, then ``tie``, within ``by``."""
    ranged = rows.withColumn("__range", F.substring(key, 1, 3))
    counts = ranged.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(key, tie))
    return ranged.join(base, [*by, "__range"]).withColumn(out, inside + F.col("__base")).drop("__range", "__base")


def permute_within(rows: DataFrame, block: list[str], ident: str, value: str, draws: int, out: str = "shuffled", give: list[str] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(draw, block, ident, value, shuffled) for draws 0..n-1: ``value`` dealt anew within every block.

    With ``give`` these columns of ``rows`` come out instead of block, ident and value.  Rows without block or ident take no part.
    """
    give = [*block, ident, value] if give is None else give
    keyed = rows.select(*dict.fromkeys([*block, ident, value, *give]))
    for c in (*block, ident):
        keyed = keyed.where(F.col(c).isNotNull())
    # at most one block in block_rows rows
    large = F.broadcast(keyed.groupBy(*block).agg(F.count("*").alias("__n")).where(F.col("__n") > block_rows).select(*block))
    held = _permute_held(keyed.join(large, block, "left_anti"), block, ident, value, draws, out, give)
    return held.unionByName(_permute_ranges(keyed.join(large, block, "left_semi"), block, ident, value, draws, out, give))


def _permute_ranges(rows: DataFrame, block: list[str], ident: str, value: str, draws: int, out: str, give: list[str]) -> DataFrame:
    """Every row of every draw takes its place by ranges of its draw key."""
    own = positions(rows.withColumn("__key", draw_key(F.col(ident), -1)), block, "__key", ident, "__at").drop("__key")
    drawn = rows.select(*block, ident, value, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    dealt = positions(drawn.withColumn("__key", draw_key(F.col(ident), F.col("draw"))), ["draw", *block], "__key", ident, "__at")
    # where a row stands does not depend on the draw, so it is worked out once
    return own.join(dealt.select("draw", *block, F.col(value).alias(out), "__at"), [*block, "__at"]).select("draw", *give, out)


def _permute_held(rows: DataFrame, block: list[str], ident: str, value: str, draws: int, out: str, give: list[str]) -> DataFrame:
    """Every block is held by the tasks that make its draws."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // DRAWS_A_TASK))).alias("__some")
    spread = rows.select("*", some).repartition(tasks, "__some", *block).sortWithinPartitions("__some", *block, ident, value)
    sent = spread.select("__some", F.col(ident).cast("string").alias("__ident"), *dict.fromkeys([*block, value, *give]))
    fields = [StructField("draw", IntegerType()), *[rows.schema[c] for c in give], StructField(out, rows.schema[value].dataType)]
    return sent.mapInArrow(_dealer(["__some", *block], value, draws, give, [f.name for f in fields]), StructType(fields))


def _starts(rows: pa.Table, keys: list[str]) -> np.ndarray:
    """Whether each row but the first differs in ``keys`` from the one before."""
    n = rows.num_rows - 1
    out = np.zeros(n, dtype=bool)
    for key in keys:
        a, b = rows[key].slice(0, n), rows[key].slice(1)
        differ = pc.not_equal(a, b)
        if pa.types.is_floating(a.type):
            differ = pc.and_not(differ, pc.and_(pc.is_nan(a), pc.is_nan(b)))
        out |= differ.to_numpy()
    return out


def _whole_blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Sorted batches as tables that never end within a block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            cuts = np.flatnonzero(_starts(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]), keys))
            if len(cuts):
                cut = int(cuts[-1])
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


#: Constants of md5: bits each step turns by, what it adds, and which word of the block it takes.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_ADDS = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts hashed at once, so that all arrays stay near the processor.
_AT_ONCE = 16_384


def _md5_block(words: list[np.ndarray], filled: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First and second half of the md5 of messages of one block: ``words`` holds what differs, ``filled`` what is alike."""
    n, u = len(words[0]), np.uint32
    taken = [w | u(f) for w, f in zip(words, filled)]
    a, b, c, d = (np.full(n, x, dtype=u) for x in _START)
    t = np.empty(n, dtype=u)
    for i in range(64):
        f = np.empty(n, dtype=u)
        if i < 16:
            np.bitwise_and(np.bitwise_xor(c, d, out=f), b, out=f)
            f ^= d
        elif i < 32:
            np.bitwise_and(np.bitwise_xor(b, c, out=f), d, out=f)
            f ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            np.bitwise_or(np.invert(d, out=f), b, out=f)
            f ^= c
        f += a
        w = _WORDS[i]
        if w < len(taken):
            f += taken[w]
            f += u(_ADDS[i])
        else:
            f += u((_ADDS[i] + filled[w]) & 0xFFFFFFFF)
        np.right_shift(f, u(32 - _TURNS[i]), out=t)
        f <<= u(_TURNS[i])
        f |= t
        f += b
        a, d, c, b = d, c, b, f
    whole = [(x + u(s)).byteswap().astype(np.uint64) for x, s in zip((a, b, c, d), _START)]
    return (whole[0] << np.uint64(32)) | whole[1], (whole[2] << np.uint64(32)) | whole[3]


class DrawKeys:
    """The md5 of ``ident#seed`` of many idents, for one seed after another, as two unsigned halves."""

    def __init__(self, idents: pa.Array):
        texts = idents.cast(pa.binary())
        lengths = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        self.n, self.alike = len(texts), []
        for length in np.unique(lengths):
            at = np.flatnonzero(lengths == length)
            some = texts.take(pa.array(at))
            if length > 40:
                self.alike.append((at, int(length), some.to_pylist()))
                continue
            # idents of one length, padded to words
            size = max(4, -(-int(length) // 4) * 4)
            padded = np.zeros((len(at), size), dtype=np.uint8)
            padded[:, :length] = np.frombuffer(b"".join(some.to_pylist()), dtype=np.uint8).reshape(len(at), length)
            self.alike.append((at, int(length), np.ascontiguousarray(padded.view("<u4").T)))

    def of(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        high, low = np.empty(self.n, dtype=np.uint64), np.empty(self.n, dtype=np.uint64)
        tail = b"#%d" % seed
        for at, length, held in self.alike:
            if isinstance(held, list):
                keys = np.frombuffer(b"".join([md5(i + tail, usedforsecurity=False).digest() for i in held]), dtype=">u8").reshape(-1, 2)
                high[at], low[at] = keys[:, 0], keys[:, 1]
                continue
            filled = bytearray(64)
            filled[length : length + len(tail) + 1] = tail + b"\x80"
            filled[56:] = (8 * (length + len(tail))).to_bytes(8, "little")
            alike = [int.from_bytes(filled[i : i + 4], "little") for i in range(0, 64, 4)]
            for k in range(0, len(at), _AT_ONCE):
                high[at[k : k + _AT_ONCE]], low[at[k : k + _AT_ONCE]] = _md5_block([w[k : k + _AT_ONCE] for w in held], alike)
        return high, low


def _order(keys: DrawKeys, seed: int, code: np.ndarray) -> np.ndarray:
    """Row numbers by block, draw key and, at equal keys, as they came."""
    high, low = keys.of(seed)
    order = np.lexsort((high, code)) if code[-1] else np.argsort(high)
    first, own = high[order], code[order]
    if ((first[1:] == first[:-1]) & (own[1:] == own[:-1])).any():
        order = np.lexsort((low, high, code))
    return order


def _dealer(keys: list[str], value: str, draws: int, give: list[str], names: list[str]) -> Callable:
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_blocks(batches, keys):
            code = np.concatenate([[0], np.cumsum(_starts(rows, keys))])
            groups = rows["__some"].to_numpy()
            # a table may have blocks of several groups of draws
            for group in np.unique(groups):
                low, high = np.searchsorted(groups, [group, group + 1])
                part, own_code = rows.slice(low, high - low), code[low:high] - code[low]
                keyed = DrawKeys(part["__ident"].combine_chunks())
                values = part[value].combine_chunks()
                kept = part.select(give).take(pa.array(_order(keyed, -1, own_code))).combine_chunks()
                for draw in range(int(group) * DRAWS_A_TASK, min(draws, (int(group) + 1) * DRAWS_A_TASK)):
                    dealt = values.take(pa.array(_order(keyed, draw, own_code)))
                    columns = [pa.array(np.full(len(dealt), draw, dtype=np.int32)), *kept.columns, dealt]
                    yield from pa.table(columns, names=names).to_batches(max_chunksize=50_000)

    return deal


def permute_masked(rows: DataFrame, mask: Column, block: list[str], ident: str, value: str, draws: int, out: str = "shuffled") -> DataFrame:
    """As ``permute_within``, where only rows that ``mask`` selects are dealt anew; the others keep their value."""
    marked = rows.select(*block, ident, value, F.coalesce(mask, F.lit(False)).alias("__m"))
    dealt = permute_within(marked.where("__m"), block, ident, value, draws, out)
    kept = marked.where("not __m").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn(out, F.col(value))
    return dealt.unionByName(kept.drop("__m"))


def bootstrap_correlation(groups: DataFrame, unit: str, x: str, y: str, draws: int, weight: str | None = None) -> DataFrame:
    """(draw, corr): the correlation over groups drawn with Poisson weights, each group weighing its draw times ``weight``."""
    drawn = bootstrap(groups.where(F.col(x).isNotNull() & F.col(y).isNotNull()), unit, draws)
    w = F.col("weight") * (F.col(weight) if weight else F.lit(1.0))
    return drawn.groupBy("draw").agg(weighted_pearson(F.col(x), F.col(y), w).alias("corr"))


def poisson_weight(ident: Column, draw: Column) -> Column:
    """Poisson(1) weight from the first eight hex digits of the draw key, by inversion."""
    u = F.conv(F.substring(draw_key(ident, draw), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    limits, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(1, 9):
        total += term
        limits.append(round(total, 12))
        term /= k
    out = F.lit(8)
    for k in range(7, -1, -1):
        out = F.when(u < limits[k], F.lit(k)).otherwise(out)
    return out


def bootstrap(rows: DataFrame, unit: str, draws: int) -> DataFrame:
    """Rows with (draw, weight): every unit (a row's id or a cluster) weighs the same in all its rows."""
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("weight", poisson_weight(F.col(unit), F.col("draw")))


def stratified_sample(rows: DataFrame, stratum: str, ident: str, size: int, seed: int = 0) -> DataFrame:
    """``size`` rows in proportion to strata by largest remainder, each stratum's picked in md5 order.

    Every stratum keeps its least draw keys.
    """
    counts = rows.groupBy(stratum).agg(F.count("*").alias("__n"))
    whole = Window.partitionBy(F.lit(0))
    exact = F.lit(float(size)) * F.col("__n") / F.sum("__n").over(whole)
    share = counts.withColumn("__exact", exact).withColumn("__base", F.floor("__exact")).withColumn("__rest", F.round(F.col("__exact") - F.col("__base"), 9))
    left = F.lit(size) - F.sum("__base").over(whole)
    rank = F.row_number().over(whole.orderBy(F.desc("__rest"), F.col(stratum)))
    quota = share.withColumn("__left", left).withColumn("__rank", rank).select(stratum, (F.col("__base") + (F.col("__rank") <= F.col("__left")).cast("int")).alias("__quota"))
    ordered = positions(rows.withColumn("__key", draw_key(F.col(ident), seed)), [stratum], "__key", ident, "__k")
    return ordered.join(quota, stratum).where("__k <= __quota").select(*rows.columns)
