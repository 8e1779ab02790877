"""Ranks, running totals and quantiles of groups of any size.

A group is cut into ranges of its values by a fixed, order-keeping function of the value, so no task orders
a group as a whole.  Per range there is a total; the totals of all lesser ranges are carried into a range in
a row of its own, and each range is then worked out by itself.  The cut depends on a value alone: it is the same
when a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges between a number and its double; all doubles make about a million, whatever the data.
PER_OCTAVE = 256


def value_range(value: Column) -> Column:
    """The range a number falls in; a greater number is never in a lesser range."""
    x = value.cast("double")

    def size(y):
        return F.floor(F.log2(y) * PER_OCTAVE) + 2000 * PER_OCTAVE

    return F.when(x > 0, size(x)).when(x < 0, -size(-x)).otherwise(F.lit(0)).cast("int")


def running_totals(rows: DataFrame, by: list[str], value: str, totals: dict[str, str], whole: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with, for each out: column of ``totals``, the column's sum over the rows of lesser ``value`` in the group,
    and for each out: column of ``whole`` its sum over the group.

    One row per group and value is expected.  Null is a group like any other; a null value takes no part.
    """
    whole = whole or {}
    ranged = rows.where(F.col(value).isNotNull()).withColumn("__r", value_range(F.col(value)))
    used = sorted({*totals.values(), *whole.values()})
    sums = ranged.groupBy(*by, "__r").agg(*[F.sum(c).alias(f"__s_{c}") for c in used])
    group = Window.partitionBy(*by)
    lesser = group.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(
        *by,
        "__r",
        *[F.coalesce(F.sum(f"__s_{c}").over(lesser), F.lit(0)).cast("double").alias(f"__b_{out}") for out, c in totals.items()],
        *[F.sum(f"__s_{c}").over(group).cast("double").alias(f"__w_{out}") for out, c in whole.items()],
        F.lit(True).alias("__carried"),
    )
    both = ranged.unionByName(carry, allowMissingColumns=True)
    inside = Window.partitionBy(*by, "__r")
    before = inside.orderBy(F.col("__carried").isNull(), value).rowsBetween(Window.unboundedPreceding, -1)
    worked = both
    for out, c in totals.items():
        worked = worked.withColumn(out, F.coalesce(F.sum(F.coalesce(f"__b_{out}", c)).over(before), F.lit(0.0)))
    for out in whole:
        worked = worked.withColumn(out, F.max(f"__w_{out}").over(inside))
    return worked.where("__carried is null").select(*rows.columns, *totals, *whole)


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on ``keys`` for which null equals null."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__k_{k}")
    on = F.lit(True)
    for k in keys:
        on = on & left[k].eqNullSafe(renamed[f"__k_{k}"])
    return left.join(renamed, on, how).drop(*[f"__k_{k}" for k in keys])


def _counts(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rows with average rank of ``value`` within ``by``; rows with a null value are left out."""
    ranked = running_totals(_counts(rows, by, value), by, value, {"__below": "__n"})
    ranked = ranked.withColumn(name, F.col("__below") + (F.col("__n") + 1) / 2).drop("__n", "__below")
    return same_keys(rows, ranked, [*by, value])


def competition_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Rows with 1 plus the number of rows of lesser ``value`` within ``by``; rows with a null value are left out."""
    ranked = running_totals(_counts(rows, by, value), by, value, {"__below": "__n"})
    ranked = ranked.withColumn(name, (F.col("__below") + 1).cast("int")).drop("__n", "__below")
    return same_keys(rows, ranked, [*by, value])


def exact_quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], out: str) -> DataFrame:
    """(by, out): exact quantiles, interpolated linearly, as an array in the order of ``shares``.

    A group without any value has no row.
    """
    ranked = running_totals(_counts(rows, by, value), by, value, {"__below": "__n"}, {"__total": "__n"})
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)])
    inside = lambda k: (F.col("__below") <= k) & (k < F.col("__below") + F.col("__n"))
    at = (F.col("__total") - 1) * F.col("w.s")
    hits = (
        ranked.select(*by, F.col(value).cast("double").alias("__v"), "__below", "__n", "__total", F.explode(wanted).alias("w"))
        .withColumn("__at", at)
        .where(inside(F.floor("__at")) | inside(F.ceil("__at")))
    )
    low, high = F.max(F.when(inside(F.floor("__at")), F.col("__v"))), F.max(F.when(inside(F.ceil("__at")), F.col("__v")))
    at = F.max("__at")
    q = F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
    each = hits.groupBy(*by, F.col("w.i").alias("__i")).agg(q.alias("__q"))
    # as many rows a group as there are shares
    return each.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__q"))), lambda x: x["__q"]).alias(out))
