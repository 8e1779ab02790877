"""Calendars and folds: sampled days, months, adaptive cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def day_windows(spark: SparkSession, start: str, end: str, step: int, zone: str = "Europe/Kyiv") -> DataFrame:
    """Every ``step``-th local calendar day from start to before end, with its instants; days with a change of clocks
    have 23 or 25 hours."""
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}' - interval 1 day, interval {int(step)} day)) as day")
    at = lambda d: F.to_utc_timestamp(d.cast("timestamp"), zone)
    return days.select("day", at(F.col("day")).alias("from_instant"), at(F.date_add("day", 1)).alias("to_instant"))


def month_windows(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Half-open months that tile the time from start's month to before end."""
    months = spark.sql(f"select explode(sequence(trunc(date'{start}', 'month'), date'{end}' - interval 1 day, interval 1 month)) as month_start")
    return months.select("month_start", F.add_months("month_start", 1).alias("month_end"))


def adaptive_cut(rows: DataFrame, year: str, train_end: int, valid_end: int, min_test: int) -> dict[str, int]:
    """Last training and last validation year: the test fold begins earlier, never later, until it has enough rows.

    One count per year reaches the driver.
    """
    counts = {r[0]: r[1] for r in rows.where(F.col(year).isNotNull()).groupBy(year).count().collect()}
    while sum(n for y, n in counts.items() if y > valid_end) < min_test and valid_end > train_end + 1:
        valid_end -= 1
    return {
        "train_end": train_end, "valid_end": valid_end, "n_train": sum(n for y, n in counts.items() if y <= train_end),
        "n_valid": sum(n for y, n in counts.items() if train_end < y <= valid_end), "n_test": sum(n for y, n in counts.items() if y > valid_end),
    }
