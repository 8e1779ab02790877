"""Variance between groups: components, intraclass correlation, split halves, covariances, fixed effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def group_moments(rows: DataFrame, by: list[str], group: str, value: str, least: int = 1) -> DataFrame:
    """Per ``by``: groups, rows, sums of squares between and within, and the effective group size n0."""
    cells = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(*by, group).agg(
        F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")
    ).where(F.col("n") >= least)
    n, k = F.sum("n"), F.count("*")
    grand = F.sum(F.col("n") * F.col("m")) / n
    return cells.groupBy(*by).agg(
        k.alias("k"), n.alias("n"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - n * grand * grand).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.try_divide(n - F.sum(F.col("n") * F.col("n")) / n, k - 1).alias("n0"),
    ).select("*", F.try_divide(F.col("ssb"), F.col("k") - 1).alias("msb"), F.try_divide(F.col("ssw"), F.nullif(F.col("n") - F.col("k"), F.lit(0))).alias("msw"))


def between_variance(moments: DataFrame) -> DataFrame:
    """Method of moments, floored at 0, and its share of the whole."""
    tau = F.greatest(F.lit(0.0), (F.col("msb") - F.col("msw")) / F.col("n0"))
    return moments.withColumn("between", tau).withColumn("share", F.try_divide(F.col("between"), F.col("between") + F.col("msw")))


def intraclass(moments: DataFrame) -> DataFrame:
    """One-way ICC, not floored."""
    return moments.withColumn("icc", F.try_divide(F.col("msb") - F.col("msw"), F.col("msb") + (F.col("n0") - 1) * F.col("msw")))


def holder_gaps(rates: DataFrame, by: list[str], train: str = "train_rate", test: str = "test_rate", tie: str = "holder") -> DataFrame:
    """Per group: the widest gap of test rates, and the one that picking by training rate recovers."""
    return rates.groupBy(*by).agg(
        F.count("*").alias("n_holders"),
        (F.max(test) - F.min(test)).alias("oracle_gap"),
        (F.max(train) - F.min(train)).alias("train_gap"),
        (F.max_by(test, F.struct(train, tie)) - F.min_by(test, F.struct(train, tie))).alias("recovered_gap"),
    ).where("n_holders >= 2")


def two_way_demeaned(rows: DataFrame, first: str, second: str, value: str, rounds: int = 1000, tolerance: float = 1e-8) -> DataFrame:
    """``value`` with the means of two groupings taken out in turn until nothing moves; ``residual`` is added.

    Still means that no group's mean is off by ``tolerance`` times the values' deviation; if that isn't reached in
    ``rounds`` it is an error.  Each round is two group sums and joins, written to the checkpoint folder; rows with a null take no part.
    """
    state = rows.where(F.col(first).isNotNull() & F.col(second).isNotNull() & F.col(value).isNotNull()).withColumn("residual", F.col(value).cast("double"))
    scale = state.agg(F.stddev_pop("residual")).first()[0] or 1.0
    for _ in range(rounds):
        for by in (first, second):
            means = state.groupBy(by).agg(F.avg("residual").alias("__m"))
            state = state.join(means, by).withColumn("residual", F.col("residual") - F.col("__m")).drop("__m")
        state = cut_lineage(state)
        moved = state.groupBy(first).agg(F.abs(F.avg("residual")).alias("m")).agg(F.max("m")).first()[0] or 0.0
        if moved < tolerance * scale:
            return state
    raise RuntimeError(f"means still move after {rounds} rounds")
