"""Checks that refuse bad data instead of letting it pass silently."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_rows(df: DataFrame, name: str, minimum: int) -> DataFrame:
    found = df.limit(minimum).count()
    if found < minimum:
        raise ValueError(f"{name} has {found} rows; at least {minimum} are needed")
    return df


def require_finite(value: float | None, name: str) -> float:
    if value is None or not math.isfinite(value):
        raise ValueError(f"{name} is {value}")
    return value


def require_mapped(df: DataFrame, original: str, mapped: str, name: str, share: float = 0.9) -> DataFrame:
    """Of the non-null originals at least ``share`` must have a mapped value."""
    row = df.agg(F.count(original).alias("n"), F.count(F.when(F.col(original).isNotNull(), F.col(mapped))).alias("m")).first()
    if row["n"] and row["m"] < share * row["n"]:
        raise ValueError(f"{name}: only {row['m']} of {row['n']} values are mapped")
    return df


def require_overlap(left: DataFrame, right: DataFrame, key: str, name: str, minimum: int = 1) -> int:
    """Keys that both sides have; fewer than ``minimum`` is refused."""
    found = left.select(key).distinct().join(right.select(key).distinct(), key, "left_semi").limit(minimum).count()
    if found < minimum:
        raise ValueError(f"{name}: {found} shared keys; at least {minimum} are needed")
    return found


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
