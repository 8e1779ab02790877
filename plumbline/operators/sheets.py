"""Published sheets: the layout they have, the header they start with, and fields turned from rows to columns."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words that headers of project sheets have.
HEADER_WORDS = ("project", "department", "cost", "baseline", "forecast", "start", "end date", "rating", "confidence")


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, line_no, cells) of every sheet of every workbook (zipped XML) under ``path``.

    Cells are texts; a shared string is looked up, a blank cell is empty.  A file that is no workbook is refused
    by giving no rows.  A workbook is read by one task, since it can't be split.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                for sheet, rows in _sheets(bytes(content)):
                    yield pd.DataFrame({"path": [name] * len(rows), "sheet": [sheet] * len(rows), "line_no": range(len(rows)), "cells": rows})

    return files.mapInPandas(run, "path string, sheet string, line_no int, cells array<string>")


def _sheets(content: bytes):
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile:
        return
    names = archive.namelist()
    tag = lambda node: node.tag.rpartition("}")[2]
    shared = []
    if "xl/sharedStrings.xml" in names:
        for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
            shared.append("".join(n.text or "" for n in item.iter() if tag(n) == "t"))
    for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
        rows = []
        for row in (n for n in ElementTree.fromstring(archive.read(name)).iter() if tag(n) == "row"):
            cells: list[str] = []
            for cell in row:
                letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                at = 0
                for c in letters:
                    at = at * 26 + ord(c) - 64
                while at and len(cells) < at - 1:
                    cells.append("")
                text = "".join(n.text or "" for n in cell.iter() if tag(n) in ("v", "t"))
                cells.append(shared[int(text)] if cell.get("t") == "s" and text.isdigit() and int(text) < len(shared) else text)
            rows.append(cells)
        yield name.rpartition("/")[2][:-4], rows


def _hits(column):
    return F.size(F.filter(column, lambda c: F.lower(c).rlike("|".join(HEADER_WORDS))))


def sheet_scores(cells: DataFrame) -> DataFrame:
    """(path, sheet, score): ten points per header word in the best row or the first column, and a capped size."""
    firsts = F.when(F.lower(F.try_element_at("cells", F.lit(1))).rlike("|".join(HEADER_WORDS)), 1).otherwise(0)
    return cells.groupBy("path", "sheet").agg(
        (10 * F.greatest(F.max(_hits(F.col("cells"))), F.sum(firsts)) + F.least(F.count("*"), F.lit(40))).alias("score")
    )


def best_sheets(cells: DataFrame) -> DataFrame:
    best = sheet_scores(cells).groupBy("path").agg(F.max_by("sheet", F.struct("score", F.col("sheet"))).alias("sheet"))
    return cells.join(best, ["path", "sheet"])


def layouts(cells: DataFrame) -> DataFrame:
    """(path, layout): ``tall`` when more header words stand in the first column than in any row, else ``wide``."""
    firsts = F.when(F.lower(F.try_element_at("cells", F.lit(1))).rlike("|".join(HEADER_WORDS)), 1).otherwise(0)
    return cells.groupBy("path").agg(F.when(F.sum(firsts) > F.max(_hits(F.col("cells"))), "tall").otherwise("wide").alias("layout"))


def wide_records(cells: DataFrame) -> DataFrame:
    """(path, record_no, header, value) of either layout: a record is a row of a wide sheet or a column of a tall one.

    Headers are made distinct by their position among equal ones; empty cells are left out.
    """
    laid = cells.join(layouts(cells), "path")
    entry = laid.select("path", "layout", "line_no", F.posexplode("cells").alias("col_no", "value"))
    wide = entry.where("layout = 'wide'")
    words = "|".join(HEADER_WORDS)
    scored = wide.groupBy("path", "line_no").agg(F.count_if(F.lower("value").rlike(words)).alias("hits"))
    head = scored.groupBy("path").agg(F.max_by("line_no", F.struct("hits", -F.col("line_no"))).alias("head"))
    joined = wide.join(head, "path")
    names = joined.where("line_no = head").select("path", "col_no", F.trim("value").alias("header"))
    rows = joined.where("line_no > head").select("path", (F.col("line_no") - F.col("head") - 1).alias("record_no"), "col_no", "value").join(names, ["path", "col_no"])
    tall = entry.where("layout = 'tall'")
    fields = tall.where("col_no = 0").select("path", "line_no", F.trim("value").alias("header"))
    columns = tall.where("col_no > 0").select("path", "line_no", (F.col("col_no") - 1).alias("record_no"), "value").join(fields, ["path", "line_no"])
    both = rows.select("path", "record_no", "header", F.col("col_no").alias("at"), "value").unionByName(columns.select("path", "record_no", "header", F.col("line_no").alias("at"), "value"))
    copy = F.row_number().over(Window.partitionBy("path", "record_no", "header").orderBy("at"))
    return both.where("trim(value) <> '' and header <> ''").withColumn("copy", copy).select(
        "path", "record_no", F.when(F.col("copy") > 1, F.concat_ws("__", "header", F.col("copy").cast("string"))).otherwise(F.col("header")).alias("header"), "value"
    )
