"""Scores of forecasts: proper rules, discrimination by ranks, calibration and decompositions.

All take rows with an outcome ``y`` (0 or 1) and a forecast ``p`` and drop pairs with a null.  Ranks and
quantiles come from counts per distinct score and range of scores (``ranks``), so no task holds a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import bin_index
from .ranks import average_ranks, exact_quantiles, running_totals, same_keys


def known(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return rows.where(F.col(y).isNotNull() & F.col(p).isNotNull() & ~F.isnan(p) & ~F.isnan(y))


def brier(y: str = "y", p: str = "p") -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), F.lit(2)))


def skill(score: Column, reference: Column) -> Column:
    """1 - score / reference; null when the reference is 0."""
    return F.lit(1.0) - F.try_divide(score, F.when(reference != 0, reference))


def log_loss(y: str = "y", p: str = "p", eps: float = 1e-9) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.col(p), F.lit(1 - eps)))
    return -F.avg(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))


def pinball(y: str, q: str, tau: float) -> Column:
    d = F.col(y) - F.col(q)
    return F.avg(F.greatest(tau * d, (tau - 1) * d))


def metric_bundle(rows: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """n, base rate, mean forecast, Brier, its skill against the base rate, log loss per group."""
    base = F.avg(y)
    return known(rows, y, p).groupBy(*by).agg(
        F.count("*").alias("n"),
        base.alias("base_rate"),
        F.avg(p).alias("mean_p"),
        brier(y, p).alias("brier"),
        skill(brier(y, p), base * (1 - base)).alias("skill"),
        log_loss(y, p).alias("log_loss"),
    )


def rank_counts(rows: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """(by, n_pos, n_neg, u): U statistic with ties counted half, per group."""
    counts = known(rows, y, p).groupBy(*by, F.col(p).alias("__p")).agg(
        F.sum(F.col(y).cast("double")).alias("pos"), F.sum(1 - F.col(y).cast("double")).alias("neg")
    )
    ranked = running_totals(counts, by, "__p", {"below": "neg"})
    return ranked.groupBy(*by).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u")
    )


def auc_by(rows: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """AUC per group (Mann-Whitney, ties half); null with one class only."""
    return rank_counts(rows, by, y, p).select(
        *by, "n_pos", "n_neg", F.try_divide(F.col("u"), F.nullif(F.col("n_pos") * F.col("n_neg"), F.lit(0.0))).alias("auc")
    )


def stratified_auc(rows: DataFrame, by: list[str], strata: list[str], min_n: int = 0, min_class: int = 1, y: str = "y", p: str = "p") -> DataFrame:
    """AUC within strata, weighted by pairs; strata that are too small or of one class are skipped and counted."""
    counts = rank_counts(rows, [*by, *strata], y, p)
    usable = (F.col("n_pos") + F.col("n_neg") >= min_n) & (F.least("n_pos", "n_neg") >= min_class)
    pairs = F.col("n_pos") * F.col("n_neg")
    return counts.groupBy(*by).agg(
        F.count_if(usable).alias("n_strata"),
        F.count_if(~usable).alias("n_skipped"),
        F.sum(F.when(usable, pairs)).alias("n_pairs"),
        F.try_divide(F.sum(F.when(usable, F.col("u"))), F.sum(F.when(usable, pairs))).alias("auc"),
    )


def cross_holder_auc(rows: DataFrame, by: list[str], outer: str, inner: str, y: str = "y", p: str = "p") -> DataFrame:
    """AUC over pairs within an outer group but across its inner groups: outer counts less inner counts."""
    wide = rank_counts(rows, [*by, outer], y, p).groupBy(*by).agg(F.sum("u").alias("u"), F.sum(F.col("n_pos") * F.col("n_neg")).alias("pairs"))
    narrow = rank_counts(rows, [*by, outer, inner], y, p).groupBy(*by).agg(F.sum("u").alias("iu"), F.sum(F.col("n_pos") * F.col("n_neg")).alias("ipairs"))
    return wide.join(narrow, by).select(
        *by, (F.col("pairs") - F.col("ipairs")).alias("n_pairs"), F.try_divide(F.col("u") - F.col("iu"), F.nullif(F.col("pairs") - F.col("ipairs"), F.lit(0.0))).alias("auc")
    )


def calibration_fixed(rows: DataFrame, by: list[str], bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Bins of equal width; empty ones are listed with n 0."""
    found = known(rows, y, p).groupBy(*by, bin_index(F.col(p), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))
    grid = known(rows, y, p).select(*by).distinct().select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(found, [*by, "bin"], "left").na.fill(0, ["n"])


def equal_count_edges(rows: DataFrame, by: list[str], value: str, bins: int) -> DataFrame:
    """(by, edges): exact quantiles with repeated ones dropped."""
    found = exact_quantiles(rows, by, value, [i / bins for i in range(bins + 1)], "edges")
    return found.withColumn("edges", F.array_distinct("edges"))


def equal_count_bin(value: Column, edges: Column) -> Column:
    """Right-closed bin with the lowest value in the first; from 0."""
    return F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e < value)) - 1)


def calibration_equal_count(rows: DataFrame, by: list[str], bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    data = known(rows, y, p)
    return (
        same_keys(data, equal_count_edges(data, by, p, bins), by)
        .groupBy(*by, equal_count_bin(F.col(p), F.col("edges")).alias("bin"))
        .agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate"))
    )


def murphy(binned: DataFrame, by: list[str]) -> DataFrame:
    """Reliability, resolution, uncertainty and expected calibration error from (by, bin, n, mean_p, rate)."""
    whole = Window.partitionBy(*by)
    rows = binned.where("n > 0").withColumn("total", F.sum("n").over(whole)).withColumn("base", F.sum(F.col("n") * F.col("rate")).over(whole) / F.sum("n").over(whole))
    w = F.col("n") / F.col("total")
    return rows.groupBy(*by).agg(
        F.sum(w * F.pow(F.col("mean_p") - F.col("rate"), F.lit(2))).alias("reliability"),
        F.sum(w * F.pow(F.col("rate") - F.col("base"), F.lit(2))).alias("resolution"),
        F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"),
        F.sum(w * F.abs(F.col("mean_p") - F.col("rate"))).alias("ece"),
    )


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation; null, not an error, when a side is constant."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def spearman_by(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks; null for fewer than three rows or a constant side."""
    data = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("__x"), F.col(y).alias("__y"))
    ranked = average_ranks(average_ranks(data, by, "__x", "rx"), by, "__y", "ry")
    n = F.count("*")
    return ranked.groupBy(*by).agg(n.alias("n"), F.when(n >= 3, correlation("rx", "ry")).alias("spearman"))


def weighted_pearson(x: Column, y: Column, w: Column) -> Column:
    sw, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    cov = F.sum(w * x * y) / sw - sx / sw * sy / sw
    vx = F.sum(w * x * x) / sw - F.pow(sx / sw, F.lit(2))
    vy = F.sum(w * y * y) / sw - F.pow(sy / sw, F.lit(2))
    return F.try_divide(cov, F.nullif(F.sqrt(F.greatest(vx, F.lit(0.0)) * F.greatest(vy, F.lit(0.0))), F.lit(0.0)))
