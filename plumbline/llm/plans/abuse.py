"""Problem 10: abusive, hateful or sexual content."""

from pyspark.sql import functions as F

from ...session import table
from ..abuse import THRESHOLD, fit_model, score_documents


def _scored(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = fit_model(documents, table(spark, sf_dir, "toxic_labels"))
    return score_documents(documents.select("doc_id", "source", "text"), model)


def p10_found(spark, sf_dir):
    return _scored(spark, sf_dir).where(F.col("score") >= THRESHOLD).select("doc_id")


def p10_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("doc_id", "score")


def p10_rates(spark, sf_dir):
    """Documents, those found, their rate and the mean score per source."""
    return _scored(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("n_documents"),
        F.count_if(F.col("score") >= THRESHOLD).alias("n_found"),
        F.round(F.avg((F.col("score") >= THRESHOLD).cast("double")), 6).alias("rate"),
        F.round(F.avg("score"), 6).alias("mean_score"),
    )


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL = {}
