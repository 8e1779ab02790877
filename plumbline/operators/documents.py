"""Documents and projects: identifiers in text columns, the document that could be known, noise, sets, thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from .ranks import exact_quantiles, same_keys


def explode_identifiers(rows: DataFrame, column: str, pattern: str = r"^P\d+$", out: str = "project") -> DataFrame:
    """One row per identifier in a column of several, divided by commas or semicolons; others are left out."""
    each = F.transform(F.split(column, "[,;]"), lambda x: F.upper(F.trim(x)))
    return rows.withColumn(out, F.explode(F.array_distinct(F.filter(each, lambda x: x.rlike(pattern)))))


def qualifying_documents(documents: DataFrame, approvals: DataFrame, grace_days: int = 30) -> DataFrame:
    """Every (document, project) with its fate: ``kept`` or the reason why not.

    A document qualifies up to ``grace_days`` after approval; of a project's qualifying documents the
    English one, then the earliest, then the least id is kept.  Approvals of a project without a date make
    its documents ``no approval date``.  The pick is a partial minimum.
    """
    dates = approvals.where("projectid is not null").groupBy("projectid").agg(F.min("boardapprovaldate").alias("approved"))
    joined = documents.where("projectid is not null").join(dates.withColumn("rated", F.lit(True)), "projectid", "left")
    late = F.col("docdt") > F.date_add("approved", grace_days)
    fate = (
        F.when(F.col("rated").isNull(), "not rated").when(F.col("approved").isNull(), "no approval date").when(F.col("docdt").isNull(), "no document date").when(late, "too late")
    )
    marked = joined.withColumn("fate", fate)
    order = F.struct((F.coalesce(F.lower(F.trim("lang")), F.lit("")) != "en").cast("int").alias("foreign"), "docdt", "doc_id")
    best = marked.where("fate is null").groupBy("projectid").agg(F.min_by("doc_id", order).alias("best"))
    return marked.join(best, "projectid", "left").select(
        "doc_id", "projectid", F.coalesce("fate", F.when(F.col("doc_id") == F.col("best"), "kept").otherwise("not first")).alias("fate")
    )


def latest_rating(rated: DataFrame) -> DataFrame:
    """One row per project: its latest evaluation, the greatest outcome text at a tie."""
    columns = [c for c in rated.columns if c != "projectid"]
    return rated.where("projectid is not null").groupBy("projectid").agg(
        F.max_by(F.struct(*columns), F.struct(F.coalesce("ieg_evaluation_fy", F.lit(-1)), F.coalesce("ieg_outcome", F.lit("")), F.coalesce("log_commitment", F.lit(-1.0)))).alias("r")
    ).select("projectid", "r.*")


def column_dictionary(df: DataFrame, columns: list[str], most_values: int = 12) -> DataFrame:
    """Per column: filled cells, distinct values, and the values where they are few.  One aggregation for all."""
    stats = df.agg(
        *[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.count_distinct(c).alias(f"d_{i}") for i, c in enumerate(columns)],
    )
    rows = stats.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("n_filled"), F.col(f"d_{i}").alias("n_distinct")) for i, c in enumerate(columns)]))
    )
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in columns]))).where("v is not null")
    small = rows.where(F.col("n_distinct") <= most_values).select("column_name")
    values = stacked.join(F.broadcast(small), "column_name", "left_semi").distinct().groupBy("column_name").agg(F.array_join(F.sort_array(F.collect_list("v")), "|").alias("the_values"))
    return rows.join(values, "column_name", "left")


def best_threshold(rows: DataFrame, by: list[str], year: str, target: str) -> DataFrame:
    """Per group: the accuracy of the best single threshold on ``year`` for a 0/1 target, in either direction.

    Counts per year are added up in order, so a group's window runs over its years.
    """
    counts = rows.where(F.col(year).isNotNull() & F.col(target).isNotNull()).groupBy(*by, year).agg(F.sum(F.col(target).cast("int")).alias("p"), F.count("*").alias("n"))
    part = Window.partitionBy(*by)
    up = part.orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    w = counts.select(
        *by, F.sum("p").over(up).alias("p_low"), F.sum("n").over(up).alias("n_low"), F.sum("p").over(part).alias("p_all"), F.sum("n").over(part).alias("n_all")
    )
    high_is_one = (F.col("n_low") - F.col("p_low")) + (F.col("p_all") - F.col("p_low"))
    right = F.greatest(high_is_one, F.col("n_all") - high_is_one, F.col("p_all"), F.col("n_all") - F.col("p_all"))
    return w.groupBy(*by).agg(F.max("n_all").alias("n"), F.round(F.max(right / F.col("n_all")), 9).alias("accuracy"))


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def word_sets(rows: DataFrame, ident: str, words: str) -> DataFrame:
    """(id, w) of rows with words: their distinct words in order."""
    return rows.where(F.col(words).isNotNull() & (F.size(words) > 0)).select(F.col(ident).alias("id"), F.array_sort(F.array_distinct(words)).alias("w"))


def set_members(rows: DataFrame, ident: str, words: str) -> DataFrame:
    """(id, representative): every id with the least id of those with an equal word set, which stands for it in ``similar_sets``."""
    sets = word_sets(rows, ident, words).distinct()
    own = sets.groupBy("w").agg(F.min("id").alias("representative"))
    return sets.join(own, "w").select("id", "representative")


def similar_sets(rows: DataFrame, ident: str, words: str, least: float) -> DataFrame:
    """Pairs of rows whose word sets have a Jaccard similarity of at least ``least``, by prefix filtering.

    Words are ordered by rarity; two sets that are similar enough share a word among the first few of each,
    so only those are joined on, and sizes must be near.  Equal sets are taken once: the result holds pairs of
    the least ids of their sets, and ``set_members`` has the ids that each of these stands for.
    """
    own = word_sets(rows, ident, words).groupBy("w").agg(F.min("id").alias("id"))
    freq = own.select(F.explode("w").alias("word")).groupBy("word").agg(F.count("*").alias("f"))
    ranked = own.select("id", F.explode("w").alias("word")).join(freq, "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("f", "word"))).alias("r"))
    rare = ranked.select("id", F.col("r.word").alias("w")).withColumn("n", F.size("w"))
    head = F.slice("w", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).cast("int"))
    prefix = rare.select("id", "n", F.explode(head).alias("word"))
    left, right = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "word"), prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "word")
    pairs = left.join(right, "word").where((F.col("a") < F.col("b")) & (F.col("na") >= least * F.col("nb")) & (F.col("nb") >= least * F.col("na"))).select("a", "b").distinct()
    checked = pairs.join(rare.select(F.col("id").alias("a"), F.col("w").alias("wa")), "a").join(rare.select(F.col("id").alias("b"), F.col("w").alias("wb")), "b")
    return checked.withColumn("similarity", jaccard(F.col("wa"), F.col("wb"))).where(F.col("similarity") >= least).select("a", "b", "similarity")


def noise_by(documents: DataFrame, by: list[str], least: int = 500) -> DataFrame:
    """Per group: documents, those with ``least`` words, and mean and middle of their marks of bad scanning and of their
    share of single letters."""
    scored = documents.withColumn("noise", E.noise_scores(F.col("text"), least)).withColumn("markers", F.col("noise.markers")).withColumn("singles", F.col("noise.singles"))
    middle = exact_quantiles(scored, by, "markers", [0.5], "q").select(*by, F.col("q")[0].alias("middle_noise"))
    rows = scored.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("markers").alias("n_scored"), F.round(F.avg("markers"), 6).alias("mean_noise"), F.round(F.avg("singles"), 6).alias("mean_singles")
    )
    return same_keys(rows, middle, by, "left").select(*by, "n", "n_scored", "mean_noise", F.round("middle_noise", 6).alias("median_noise"), "mean_singles")
