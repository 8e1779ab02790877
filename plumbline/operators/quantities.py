"""Amounts entered in different units, converted to pounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import cell_parts, effective_factor, life_cost_parts, note_unit, pounds, unit_around, unit_factor

#: Columns of amounts that are to be in millions of pounds, and the narrative that states the whole-life cost.
CELLS = ("wlc_baseline_gbp_m", "fy_forecast_gbp_m")
NARRATIVE = "wlc_narrative"


def amounts_in_pounds(panel: DataFrame, keep: list[str], cells: tuple[str, ...] = CELLS, narrative: str = NARRATIVE, with_narrative: bool = True) -> DataFrame:
    """``keep`` plus field_name, pounds (long) and unit_factor (pounds per unit as entered), one row per
    amount that can be read.

    An amount's unit is the one written with it, else the one that the row's narrative states for all
    its figures, else told by its size: a bare number from half a million up is whole pounds, below
    it is millions.  Fillers, prose and nulls give no row; repeated rows each give theirs.
    """
    parsed = panel.select(
        *keep,
        note_unit(F.col(narrative)).alias("__note"),
        *[cell_parts(F.col(c)).alias(f"__{c}") for c in cells],
        *([life_cost_parts(F.col(narrative)).alias(f"__{narrative}")] if with_narrative else []),
    ).withColumn("__note", unit_factor(F.col("__note")))
    none = F.lit(None).cast("string")
    read = [F.struct(F.lit(c).alias("field_name"), F.col(f"__{c}.number").alias("number"), F.col(f"__{c}.unit").alias("unit"), none.alias("before"), none.alias("after")) for c in cells]
    if with_narrative:
        life = F.col(f"__{narrative}")
        read.append(F.struct(F.lit(narrative).alias("field_name"), life["number"].alias("number"), none.alias("unit"), life["before"].alias("before"), life["after"].alias("after")))
    stacked = parsed.select(*keep, "__note", F.inline(F.array(*read))).where("number is not null")
    # a cell's text around its number is its unit; in a narrative the unit is what touches the number
    own = stacked.withColumn("__cell", unit_factor(F.col("unit"))).withColumn("__text", unit_around(F.col("before"), F.col("after")))
    own = own.withColumn("__own", F.coalesce("__cell", "__text"))
    return own.select(
        *keep,
        "field_name",
        pounds(F.col("number"), F.col("__own"), F.col("__note")).alias("pounds"),
        effective_factor(F.col("number"), F.col("__own"), F.col("__note")).alias("unit_factor"),
    )


def foreign_amounts(panel: DataFrame) -> DataFrame:
    """(row_id, field_name, pounds) of every amount that was entered in another unit than millions."""
    return amounts_in_pounds(panel, ["row_id"]).where("unit_factor <> 1e6").select("row_id", "field_name", "pounds")
