"""Forecast ladders: boosted trees picked on validation, quantile baselines, text logit, isotonic steps.

Models are fitted with Spark ML on training rows only.  Numeric gaps get the training median and an
indicator, categories their frequency order with a level for unseen ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Imputer, NGram, Normalizer, RegexTokenizer, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_pipeline(numeric: list[str], codes: list[str], most: int = 254) -> Pipeline:
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep", stringOrderType="frequencyDesc") for c in codes]
    imputer = Imputer(inputCols=numeric, outputCols=[f"{c}__n" for c in numeric], strategy="median")
    assembler = VectorAssembler(inputCols=[*(f"{c}__n" for c in numeric), *(f"{c}__missing" for c in numeric), *(f"{c}__k" for c in codes)], outputCol="features")
    return Pipeline(stages=[*indexers, imputer, _Cap([f"{c}__i" for c in codes], [f"{c}__k" for c in codes], most), assembler])


class _Cap(VectorAssembler):
    """Index columns cut at a most frequent number, the rest sharing one level."""

    def __init__(self, inputs: list[str], outputs: list[str], most: int):
        super().__init__()
        self.inputs, self.outputs, self.most = inputs, outputs, most

    def transform(self, dataset: DataFrame, params=None) -> DataFrame:
        return dataset.withColumns({o: F.least(F.col(i), F.lit(float(self.most))) for i, o in zip(self.inputs, self.outputs, strict=True)})


def with_missing(df: DataFrame, numeric: list[str]) -> DataFrame:
    return df.withColumns({f"{c}__missing": F.col(c).isNull().cast("double") for c in numeric} | {c: F.col(c).cast("double") for c in numeric})


def staged_margins(model, scored: DataFrame, column: str = "features") -> DataFrame:
    """``scored`` with ``margins``: the boosted margin after every tree, from one pass over the rows."""
    trees, weights = model.trees, list(model.treeWeights)
    out = scored
    for i, tree in enumerate(trees):
        out = tree.setFeaturesCol(column).setPredictionCol(f"__t{i}").transform(out)
    total, steps = F.lit(0.0), []
    for i, w in enumerate(weights):
        total = total + F.lit(w) * F.col(f"__t{i}")
        steps.append(total)
    return out.withColumn("margins", F.array(*steps)).drop(*[f"__t{i}" for i in range(len(trees))])


def fit_boosted(train: DataFrame, val: DataFrame, numeric: list[str], codes: list[str], y: str, trees: int = 12, depth: int = 4):
    """(pipeline model, boosted model, number of trees with the least validation Brier)."""
    pipe = feature_pipeline(numeric, codes).fit(with_missing(train, numeric))
    ready = pipe.transform(with_missing(train, numeric)).select("features", F.col(y).cast("double").alias("label")).persist()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=256, stepSize=0.2, seed=7).fit(ready)
    ready.unpersist()
    scored = staged_margins(model, pipe.transform(with_missing(val, numeric)))
    losses = scored.select(F.posexplode(F.transform("margins", lambda m: F.pow(1 / (1 + F.exp(-2 * m)) - F.col(y), F.lit(2)))).alias("k", "loss")).groupBy("k").agg(F.avg("loss").alias("loss"))
    best = losses.orderBy("loss", "k").first()
    return pipe, model, (best["k"] + 1 if best else trees)


def predict_boosted(fitted, rows: DataFrame, numeric: list[str]) -> DataFrame:
    pipe, model, k = fitted
    scored = staged_margins(model, pipe.transform(with_missing(rows, numeric)))
    return scored.withColumn("forecast", 1 / (1 + F.exp(-2 * F.element_at("margins", k))))


def permutation_importance(fitted, rows: DataFrame, numeric: list[str], column: str, ident: str, y: str) -> float:
    """Rise of the Brier score when one column is dealt anew in the order of a hash."""
    from .resample import permute_within

    dealt = permute_within(rows.select(ident, column).withColumn("__b", F.lit(0)), ["__b"], ident, column, 1).select(ident, "shuffled")
    mixed = rows.drop(column).join(dealt, ident).withColumnRenamed("shuffled", column)
    score = lambda df: predict_boosted(fitted, df, numeric).agg(F.avg(F.pow(F.col("forecast") - F.col(y), F.lit(2)))).first()[0]
    return (score(mixed) or 0.0) - (score(rows) or 0.0)


def partial_dependence(fitted, rows: DataFrame, numeric: list[str], column: str, grid: list[float]) -> DataFrame:
    """Mean forecast with the column set to every value of a fixed grid."""
    spread = rows.withColumn(column, F.explode(F.array(*[F.lit(g) for g in grid])))
    return predict_boosted(fitted, spread, numeric).groupBy(F.col(column).alias("value")).agg(F.avg("forecast").alias("mean_forecast"))


def text_pipeline(text: str = "text", terms: int = 20_000, least: int = 5) -> Pipeline:
    """Words and pairs of words, damped counts, smoothed idf, unit length."""
    words = RegexTokenizer(inputCol=text, outputCol="__words", pattern=r"[^\p{L}\p{N}]+", minTokenLength=2)
    kept = StopWordsRemover(inputCol="__words", outputCol="__kept")
    pairs = NGram(n=2, inputCol="__kept", outputCol="__pairs")
    one = CountVectorizer(inputCol="__kept", outputCol="__c1", vocabSize=terms, minDF=least)
    two = CountVectorizer(inputCol="__pairs", outputCol="__c2", vocabSize=terms, minDF=least)
    joined = VectorAssembler(inputCols=["__c1", "__c2"], outputCol="__counts")
    return Pipeline(stages=[words, kept, pairs, one, two, joined, IDF(inputCol="__counts", outputCol="__idf"), Normalizer(inputCol="__idf", outputCol="features")])


def fit_text(train: DataFrame, y: str, penalty: float = 0.01):
    pipe = text_pipeline().fit(train)
    ready = pipe.transform(train).select("features", F.col(y).cast("double").alias("label"))
    return pipe, LogisticRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=30).fit(ready)


def predict_text(fitted, rows: DataFrame) -> DataFrame:
    pipe, model = fitted
    return model.transform(pipe.transform(rows)).withColumn("forecast", vector_to_array("probability")[1])


def fit_isotonic(train: DataFrame, x: str, y: str) -> tuple[list[float], list[float]]:
    """Knots of the non-decreasing fit; their number is bounded by the distinct values of x."""
    model = IsotonicRegression(featuresCol=x, labelCol=y).fit(train.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).where(f"{x} is not null and {y} is not null"))
    return list(model.boundaries.toArray()), list(model.predictions.toArray())


def isotonic_step(value: Column, knots: tuple[list[float], list[float]]) -> Column:
    """The step at or below the value, clamped at both ends; found by bisection, so many knots cost little."""
    xs, ys = np.array(knots[0]), np.array(knots[1])

    @F.pandas_udf("double")
    def step(values: pd.Series) -> pd.Series:
        at = np.clip(np.searchsorted(xs, values.to_numpy(float), "right") - 1, 0, len(xs) - 1)
        return pd.Series(np.where(values.isna(), np.nan, ys[at]), index=values.index).astype("Float64").mask(values.isna())

    return step(value.cast("double"))


def isotonic_levels(rows: DataFrame, by: list[str], level: str, y: str) -> DataFrame:
    """(by, level, n, fitted): non-decreasing means over a scale of few levels, per group and without a driver.

    Of a least-squares fit the value at a level is the greatest, over starts at or below it, of the least mean, over ends at or
    above it, of the levels from start to end.  Rows with a null take no part.  A group's levels, at most 1,000, stand in one array.
    """
    counts = rows.where(F.col(level).isNotNull() & F.col(y).isNotNull()).groupBy(*by, level).agg(F.count("*").alias("n"), F.sum(F.col(y).cast("double")).alias("s"))
    held = counts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(level).alias("level"), "n", "s"))).alias("c"))
    held = held.withColumn("c", F.when(F.size("c") <= 1000, F.col("c")).otherwise(F.raise_error(F.lit("a scale has at most 1,000 levels"))))

    def total(part, field):
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x[field])

    def mean(i, k):
        part = F.slice("c", i + 1, k - i + 1)
        return total(part, "s") / total(part, "n")

    size = F.size("c")
    fit = F.transform("c", lambda x, j: F.array_max(F.transform(F.sequence(F.lit(0), j), lambda i: F.array_min(F.transform(F.sequence(j, size - 1), lambda k: mean(i, k))))))
    return held.select(*by, F.inline(F.arrays_zip("c", fit.alias("fitted")))).select(*by, F.col("c.level").alias(level), F.col("c.n").alias("n"), "fitted")
