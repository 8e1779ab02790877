"""Reference classes: shrunken cell means, flat and by levels, lumping of categories, quantile edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shrunken_means(train: DataFrame, target: DataFrame, keys: list[str], y: str, k: float) -> DataFrame:
    """``target`` with ``cell_n`` and ``prediction``: its cell's mean in ``train``, shrunk to the overall mean
    by k rows; a cell not seen in training gets the overall mean."""
    overall = train.agg(F.avg(y).alias("__base"))
    cells = train.where(F.col(y).isNotNull()).groupBy(*keys).agg(F.count(y).alias("cell_n"), F.sum(y).alias("__s"))
    base = overall.first()[0]
    joined = target.join(cells, keys, "left")
    value = F.when(F.col("cell_n").isNotNull(), (F.col("__s") + k * F.lit(base)) / (F.col("cell_n") + k)).otherwise(F.lit(base))
    return joined.withColumn("prediction", value).withColumn("cell_n", F.coalesce("cell_n", F.lit(0))).drop("__s")


def level_means(train: DataFrame, levels: list[list[str]], y: str, k: float) -> list[DataFrame]:
    """Shrunken means of nested levels, coarsest first; each shrinks to the mean of its rows' parent values."""
    base = train.agg(F.avg(y)).first()[0]
    rows = train.where(F.col(y).isNotNull()).withColumn("__parent", F.lit(base))
    out = []
    for depth, keys in enumerate(levels):
        cells = rows.groupBy(*keys).agg(
            F.count("*").alias(f"n_{depth}"), ((F.sum(y) + k * F.avg("__parent")) / (F.count("*") + k)).alias(f"m_{depth}")
        )
        out.append(cells)
        rows = rows.join(cells.select(*keys, f"m_{depth}"), keys).withColumn("__parent", F.col(f"m_{depth}")).drop(f"m_{depth}")
    return out


def predict_levels(target: DataFrame, levels: list[list[str]], means: list[DataFrame], base: Column) -> DataFrame:
    """The finest level that has the row's cell; ``level`` tells which (-1 for none)."""
    rows = target
    for depth, (keys, cells) in enumerate(zip(levels, means, strict=True)):
        rows = rows.join(cells.select(*keys, f"m_{depth}"), keys, "left")
    order = range(len(levels) - 1, -1, -1)
    return rows.withColumn("prediction", F.coalesce(*[F.col(f"m_{d}") for d in order], base)).withColumn(
        "level", F.coalesce(*[F.when(F.col(f"m_{d}").isNotNull(), F.lit(d)) for d in order], F.lit(-1))
    ).drop(*[f"m_{d}" for d in order])


def top_categories(train: DataFrame, column: str, most: int = 254) -> DataFrame:
    """The most frequent values, null being one of them; the lesser value first at a tie."""
    value = F.coalesce(F.col(column), F.lit("__NULL__"))
    counts = train.groupBy(value.alias("value")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(most)


def lump(df: DataFrame, column: str, kept: DataFrame) -> DataFrame:
    """``column`` with values outside ``kept`` replaced by ``__OTHER__``.  ``kept`` has a fixed most rows."""
    value = F.coalesce(F.col(column), F.lit("__NULL__"))
    marked = df.withColumn("__v", value).join(F.broadcast(kept.select(F.col("value").alias("__v"), F.lit(True).alias("__in"))), "__v", "left")
    return marked.withColumn(column, F.when(F.col("__in"), F.col("__v")).otherwise("__OTHER__")).drop("__v", "__in")


def right_open_bin(value: Column, edges: Column) -> Column:
    """How many edges are at or below the value, as text; ``NA`` for null."""
    return F.when(value.isNull(), "NA").otherwise(F.size(F.filter(edges, lambda e: e <= value)).cast("string"))


def climatology(rows: DataFrame, at: str, y: str, least: int = 20) -> DataFrame:
    """(at, n_before, climatology): mean outcome of strictly earlier positions, null below ``least`` rows.

    The window runs over positions, of which there is one row each.
    """
    sums = rows.where(F.col(y).isNotNull()).groupBy(at).agg(F.count(y).alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    before = Window.partitionBy(F.lit(0)).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(
        at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.when(F.sum("n").over(before) >= least, F.sum("s").over(before) / F.sum("n").over(before)).alias("climatology")
    )
