"""Problem 8: encoding of the whole corpus with a public tokenizer."""

from pyspark.sql import functions as F

from ...session import table
from ..tokens import decode_documents, encode_documents


def p8_ids(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_round_trip(spark, sf_dir):
    """Documents, tokens and texts that come back unchanged from their ids, per source."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    encoded = encode_documents(documents.withColumn("whole", F.coalesce("text", F.lit(""))))
    decoded = decode_documents(encoded.withColumn("n_tokens", F.size("ids").cast("long")))
    return decoded.groupBy("source").agg(
        F.count("*").alias("n_documents"),
        F.sum("n_tokens").alias("n_tokens"),
        F.count_if(F.col("text") == F.col("whole")).alias("n_restored"),
    )


QUERIES = {"p8_ids": p8_ids, "p8_round_trip": p8_round_trip}
SQL = {}
