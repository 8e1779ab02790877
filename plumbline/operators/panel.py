"""Snapshot panels: exact offsets, coverage-aware absence, earlier and later values, cross-tabs.

``panel`` has one row per (key, idx), idx counting positions; gaps stay gaps, so neighbours are found by
equality on idx + k and never by order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offset_values(panel: DataFrame, key: str, idx: str, columns: list[str], offset: int, suffix: str) -> DataFrame:
    """The panel with the columns' values at exactly ``idx + offset``; null where that position is missing."""
    other = panel.select(key, (F.col(idx) - offset).alias(idx), *[F.col(c).alias(f"{c}{suffix}") for c in columns], F.lit(True).alias(f"present{suffix}"))
    return panel.join(other, [key, idx], "left").withColumn(f"present{suffix}", F.coalesce(f"present{suffix}", F.lit(False)))


def absences(panel: DataFrame, key: str, idx: str, body: str) -> DataFrame:
    """The panel with ``absent_next`` (null where the body published nothing next) and ``exits``: whether the key
    never comes again although its body publishes later."""
    covered = panel.select(body, (F.col(idx) - 1).alias(idx)).distinct().withColumn("covered_next", F.lit(True))
    last_key = panel.groupBy(key).agg(F.max(idx).alias("__last_key"))
    last_body = panel.groupBy(body).agg(F.max(idx).alias("__last_body"))
    nxt = panel.select(key, (F.col(idx) - 1).alias(idx)).distinct().withColumn("__next", F.lit(True))
    out = panel.join(covered, [body, idx], "left").join(nxt, [key, idx], "left").join(last_key, key).join(last_body, body)
    return out.select(
        *panel.columns,
        F.when(F.col("covered_next"), F.col("__next").isNull()).alias("absent_next"),
        F.when(F.col("__last_body") > F.col(idx), F.col("__last_key") == F.col(idx)).alias("exits"),
    )


def column_values(rows: DataFrame, column: str, most: int = 1000) -> list[str]:
    """The distinct values that are to become columns, in order; refuses more than ``most``, which no table holds."""
    found = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values; they can't become columns")
    return sorted(found)


def cross_tab(panel: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """Counts by ``by`` in the fixed order of ``values``."""
    return panel.groupBy(by).pivot(column, values).count().na.fill(0)


def conflict_dedupe(rows: DataFrame, key: list[str], signature: Column, order: list[Column]) -> DataFrame:
    """One row of each (key, signature), with ``variant`` 1, 2, ... for keys whose rows contradict each other and 0
    for the others.  Variants are numbered over distinct signatures, of which a key has few."""
    firsts = rows.withColumn("__sig", signature)
    columns = [c for c in rows.columns if c not in key]
    kept = firsts.groupBy(*key, "__sig").agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("r"), F.count("*").alias("n_copies"))
    many = Window.partitionBy(*key)
    ranked = kept.withColumn("n_signatures", F.count("*").over(many)).withColumn("__rank", F.row_number().over(many.orderBy("__sig")))
    return ranked.select(*key, "r.*", "n_copies", F.when(F.col("n_signatures") > 1, F.col("__rank")).otherwise(0).alias("variant"))
