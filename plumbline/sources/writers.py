"""Writers: partitioned tables, release files, manifests, and checks that what was written reads back equal."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import read_csv_exact


def write_table(df: DataFrame, path: str, by: list[str] = ()) -> None:
    """Zstandard Parquet, in folders by ``by``, each value's rows in few files."""
    out = df.repartition(*by) if by else df
    out.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_release(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*[F.col(c).cast("string").alias(c) for c in columns]).write.mode("overwrite").option("header", True).option("compression", "gzip").option("escape", '"').csv(path)


def verify_csv_round_trip(spark: SparkSession, df: DataFrame, path: str) -> bool:
    """Whether a written release holds exactly the rows of ``df`` as text, repeated rows counted."""
    want = df.select(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    got = read_csv_exact(spark, path, df.columns).select(*df.columns)
    return want.exceptAll(got).isEmpty() and got.exceptAll(want).isEmpty()


def merge_manifest(old: DataFrame, new: DataFrame, key: str, error: str = "error") -> DataFrame:
    """New entries win over old ones, but an entry with an error never replaces a good one."""
    columns = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*columns).alias("o"))
    b = new.select(key, F.struct(*columns).alias("n"))
    joined = a.join(b, key, "full_outer")
    keep_old = F.col("n").isNull() | (F.col(f"n.{error}").isNotNull() & F.col("o").isNotNull() & F.col(f"o.{error}").isNull())
    return joined.select(key, F.when(keep_old, F.col("o")).otherwise(F.col("n")).alias("r")).select(key, "r.*")


def record_timing(path: str, step: str, seconds: float, **extra: object) -> None:
    """Merge one step's wall time into a JSON file."""
    file = Path(path)
    known = json.loads(file.read_text()) if file.exists() else {}
    known[step] = {"seconds": round(seconds, 3), **extra}
    file.write_text(json.dumps(known, indent=1, sort_keys=True))
