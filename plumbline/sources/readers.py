"""Readers for the shapes that raw records come in; all give strings first and types by ``try_cast``."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.guards import require_columns


def strings(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_csv_exact(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV where only the empty cell is null: leading zeros and the text NA survive.  The header must have ``columns``."""
    found = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').option("nullValue", "").csv(path)
    return require_columns(found, columns)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines, plain or gzipped; damaged lines and a cut-off tail are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(path)


def latest_version(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of greatest order per key."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str], required: list[str] = (), batch: int = 20_000) -> DataFrame:
    """Every .csv member of every zip under ``path``: the wanted columns as strings, null where a member lacks one.

    A zip can't be split, so each is streamed by one task in batches of rows.  A member without a
    required column is refused.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    wanted, needed = list(columns), set(required)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.namelist():
                        if not member.lower().endswith(".csv"):
                            continue
                        with archive.open(member) as raw:
                            reader = csv.DictReader(io.TextIOWrapper(raw, "utf-8-sig", newline=""))
                            lacking = needed - set(reader.fieldnames or [])
                            if lacking:
                                raise ValueError(f"{name}/{member} lacks {sorted(lacking)}")
                            rows = []
                            for row in reader:
                                rows.append([row.get(c) or None for c in wanted])
                                if len(rows) >= batch:
                                    yield pd.DataFrame(rows, columns=wanted)
                                    rows = []
                            yield pd.DataFrame(rows, columns=wanted)

    return files.mapInPandas(run, strings(wanted))


def read_csv_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, cells): raw CSV rows of small files in UTF-8, Windows or Latin encoding, without a header."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                for encoding in ("utf-8-sig", "cp1252", "latin-1"):
                    try:
                        text = bytes(content).decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                rows = [r for r in csv.reader(io.StringIO(text)) if any(x.strip() for x in r)]
                yield pd.DataFrame({"path": [name] * len(rows), "line_no": range(len(rows)), "cells": rows})

    return files.mapInPandas(run, "path string, line_no int, cells array<string>")


def header_row(cells: DataFrame, words: list[str], most: int = 12) -> DataFrame:
    """(path, header_line): the line among the first ``most`` that looks most like a header: ten points per cell
    with one of ``words``, one per filled cell (forty at most)."""
    hit = F.size(F.filter("cells", lambda c: F.lower(c).rlike("|".join(words))))
    filled = F.least(F.size(F.filter("cells", lambda c: F.trim(c) != "")), F.lit(40))
    scored = cells.where(F.col("line_no") < most).withColumn("score", 10 * hit + filled)
    return scored.groupBy("path").agg(F.max_by("line_no", F.struct("score", -F.col("line_no"))).alias("header_line"))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of whole text files, whatever their length."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("name"), F.col("value").alias("text"))


def coerce(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to their types; what can't be cast is null, never an error."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def years_counted(df: DataFrame, year: str) -> DataFrame:
    """(year, n) for every year between the first and the last; n is 0 for a year without a row."""
    years = df.select(F.col(year).alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("n"))
    span = years.agg(F.explode(F.sequence(F.min("year"), F.max("year"))).alias("year"))
    return span.join(years, "year", "left").na.fill(0, ["n"])


def years_missing(df: DataFrame, year: str) -> DataFrame:
    """Years between the first and the last that have no row."""
    return years_counted(df, year).where("n = 0").select("year")


def schema_difference(df: DataFrame, wanted: dict[str, str]) -> list[tuple[str, str | None, str | None]]:
    """(column, wanted type, delivered type) of what is missing, extra or of another type."""
    have = dict(df.dtypes)
    return [(c, wanted.get(c), have.get(c)) for c in sorted({*wanted, *have}) if wanted.get(c) != have.get(c)]
