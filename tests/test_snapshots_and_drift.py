import datetime as dt
import json
import random

import pytest

from plumbline.operators.drift import alternatives, path_unions, schema_changes, table_branches, unified_table
from plumbline.operators.snapshots import project_changes, project_snapshots, snapshot_changes
from plumbline.plans import drift as drift_queries

D = [dt.date(2019 + i, 3, 31) for i in range(4)]


def brute(rows, fields):
    dates = sorted({r[1] for r in rows})
    by = {(r[0], r[1]): r[2:] for r in rows}
    out = set()
    for old, new in zip(dates, dates[1:], strict=False):
        for key in {r[0] for r in rows}:
            a, b = by.get((key, old)), by.get((key, new))
            if a is None and b is not None:
                out.add((key, new, "added", "record"))
            elif a is not None and b is None:
                out.add((key, new, "removed", "record"))
            elif a is not None:
                out |= {(key, new, "changed", f) for f, x, y in zip(fields, a, b, strict=True) if x != y}
    return out


@pytest.mark.parametrize(("leaves", "fanout"), [(256, 16), (16, 4), (1, 2)])
def test_changes_match_brute_force(spark, leaves, fanout):
    rng = random.Random(5)
    rows = [(f"k{k}", d, rng.choice([None, "x", "y"]), rng.choice([1, 2, None])) for k in range(40) for d in D if rng.random() < 0.7]
    df = spark.createDataFrame(rows, "k string, d date, a string, b int")
    got = {tuple(r) for r in snapshot_changes(df, "k", "d", ["a", "b"], leaves, fanout).collect()}
    assert got == brute(rows, ["a", "b"])


def test_no_changes_and_empty(spark):
    df = spark.createDataFrame([("k", d, "x") for d in D], "k string, d date, a string")
    assert snapshot_changes(df, "k", "d", ["a"]).count() == 0
    assert snapshot_changes(df.limit(0), "k", "d", ["a"]).count() == 0
    assert snapshot_changes(df.where("d = date'2019-03-31'"), "k", "d", ["a"]).count() == 0


PANEL = "row_id long, project_name string, dca_ipa string, end_date string, wlc_baseline_gbp_m string, wlc_narrative string, portfolio_id string, snapshot_date date, source_kind string, published_at timestamp_ntz"


def test_meaning_of_values_and_choice_of_rows(spark):
    t = dt.datetime(2019, 6, 1)
    rows = [
        (1, "Hill Road Scheme", "G", "01/02/2030", "100", None, "P1", D[0], "final", t),
        (2, "Hill Road Scheme", "R", "01/02/2031", "1", None, "P1", D[0], "draft", t + dt.timedelta(days=9)),
        (3, "HILL-ROAD scheme", "green", "1 February 2030", "£0.1bn", None, "P1", D[1], "final", t),
        (4, "Hill Road Sch…", "TBC", "TBC", "100000000", None, "P1", D[2], "final", t),
        (5, "Hill Road Scheme", None, None, None, None, "P2", D[2], "final", None),
        (6, "Other", "R", None, None, None, None, D[0], "final", t),
        (7, "Lane", "A/R", "x", "7", None, "P3", D[0], None, None),
        (8, None, "A/R", "y", "7", None, "P3", D[1], None, None),
    ]
    df = spark.createDataFrame(rows, PANEL)
    chosen = {(r["portfolio_id"], r["snapshot_date"]): r for r in project_snapshots(df).collect()}
    assert chosen["P1", D[0]]["dca_ipa"] == "G" and chosen["P1", D[0]]["wlc_baseline_gbp_m"] == 100_000_000
    assert {tuple(r) for r in project_changes(df).collect()} == {
        ("P1", "2021-03-31", "changed", "project_name"), ("P1", "2021-03-31", "changed", "dca_ipa"), ("P1", "2021-03-31", "changed", "end_date"), ("P2", "2021-03-31", "added", "record"),
        ("P3", "2020-03-31", "changed", "project_name"), ("P3", "2020-03-31", "changed", "end_date"), ("P3", "2021-03-31", "removed", "record"),
    }
    assert project_changes(df.limit(0)).count() == 0


def publications(spark, files):
    rows = [(i, slug, n, None, json.dumps(r) if isinstance(r, dict) else r) for i, (slug, n, r) in enumerate((s, n, r) for s, rs in files.items() for n, r in enumerate(rs))]
    return spark.createDataFrame(rows, "record_id long, publication_slug string, row_no int, delivered_at timestamp_ntz, record string")


def calendar(spark, rows):
    return spark.createDataFrame(rows, "publication_slug string, publishing_body string, publication_year int, money_header_implies string")


def test_drift(spark):
    files = {
        "a-13": [{"Project": "x", "Start": "2013-01-01", "WLC approved": 3.5, "Check": 1}, {"Project": None, "Start": None}, "not json", None],
        "a-15": [{"PROJECT (see note 2)": "x", "Date begun": 41000, "WLC approved": {"amount": 3.5}, "RAG": None, "Check": "x"}] * 2,
        "a-16": [{" Project_": "y", "Evaluation": True, "Budget for the year 2015/16": 1, "RAG": "G"}],
        "b-13": [{"Project": "z"}],
    }
    cal = [("a-13", "a", 2013, "30/09/2012"), ("a-15", "a", 2015, "2014-15"), ("a-16", "a", 2016, None), ("b-13", "b", 2013, "41182"), ("c-13", None, 2013, "x"), ("d", "d", None, None)]
    got = {tuple(r) for r in schema_changes(publications(spark, files), calendar(spark, cal)).collect()}
    assert got == {
        ("a-15", "start_date", "renamed"), ("a-15", "start_date", "type_changed"), ("a-15", "wlc_baseline_gbp_m", "type_changed"), ("a-15", "money_header_implies", "type_changed"),
        ("a-16", "start_date", "removed"), ("a-16", "wlc_baseline_gbp_m", "removed"), ("a-16", "evaluation_plan", "added"), ("a-16", "fy_baseline_gbp_m", "added"), ("a-16", "dca_ipa", "added"),
        ("a-16", "money_header_implies", "removed"),
    }
    rows = {(r["publication_slug"], r["row_no"]): r for r in unified_table(publications(spark, files), calendar(spark, cal)).collect()}
    assert rows["a-15", 0]["wlc_baseline_gbp_m_value"] == 3.5 and rows["a-15", 0]["start_date_date"] == dt.date(2012, 4, 1) and rows["a-16", 0]["evaluation_planned"] is True
    assert rows["a-13", 2]["project_name"] is None and rows["a-13", 0]["money_header_implies"] == "30/09/2012"
    empty = publications(spark, files).limit(0)
    assert schema_changes(empty, calendar(spark, cal).limit(0)).count() == 0 and unified_table(empty, calendar(spark, cal)).count() == 0


def test_unions_per_path_and_appearing_alternatives(spark):
    files = {
        "a-13": [{"WLC approved": 3.5, "Aims": "x"}, {"WLC approved": {"amount": 3, "by": [1, {"k": "v"}]}}],
        "a-15": [{"WLC approved": {"amount": "3", "by": []}, "Aims": ["x", None]}],
        "a-16": [{"Aims": ["x"], "RAG": "G"}],
    }
    cal = [(s, "a", 2000 + int(s[2:]), None) for s in files]
    unions = {(r["publication_slug"], r["field_name"], r["path"]): r["types"] for r in path_unions(publications(spark, files)).collect()}
    wlc = {k[2]: v for k, v in unions.items() if k[:2] == ("a-13", "wlc_baseline_gbp_m")}
    assert wlc == {"$": ["number", "object"], "$.amount": ["number"], "$.by": ["array"], "$.by[]": ["number", "object"], "$.by[].k": ["string"]}
    got = {tuple(r) for r in alternatives(publications(spark, files), calendar(spark, cal)).collect()}
    w, d = "wlc_baseline_gbp_m", "description"
    assert got == {
        ("a-15", w, "$", "number", "vanished"), ("a-15", w, "$.amount", "string", "appeared"), ("a-15", w, "$.amount", "number", "vanished"), ("a-15", w, "$.by[]", "number", "vanished"), ("a-15", w, "$.by[]", "object", "vanished"),
        ("a-15", w, "$.by[].k", "string", "vanished"), ("a-15", d, "$", "string", "vanished"), ("a-15", d, "$", "array", "appeared"), ("a-15", d, "$[]", "string", "appeared"),
    }
    assert alternatives(publications(spark, files).limit(0), calendar(spark, cal)).count() == 0


def test_branches_units_and_repeated_headers(spark):
    files = {"a-13": [{"WLC approved (£k)": 2500, "Lifetime cost": "£3bn", "Expected benefits": {"amount": 4, "unit": "£bn"}}, {"WLC approved (£k)": None, "Lifetime cost": "7"}, {}]}
    rows = {r["row_no"]: r for r in unified_table(publications(spark, files), calendar(spark, [])).collect()}
    # the least header counts, the other one of the same field is kept beside
    assert rows[0]["wlc_baseline_gbp_m_value"] == 3000.0 and [m["header"] for m in rows[0]["more"]] == ["WLC approved (£k)"] and rows[0]["benefits_baseline_gbp_m_value"] == 4000.0
    assert rows[0]["wlc_baseline_gbp_m__string"] == "£3bn" and rows[1]["wlc_baseline_gbp_m__number"] is None and rows[1]["wlc_baseline_gbp_m_value"] == 7.0 and not rows[1]["more"]
    assert rows[2]["wlc_baseline_gbp_m"] is None
    other = {"a-13": [{"WLC approved (£k)": 2500}]}
    assert unified_table(publications(spark, other), calendar(spark, [])).first()["wlc_baseline_gbp_m_value"] == 2.5


def test_the_one_table_holds_every_cell(spark):
    files = {
        "a-13": [{"WLC approved (£k)": 2500, "Lifetime cost": "£3bn", "Aims": ["x", {"k": 1}]}, {"WLC approved (£k)": {"amount": 1}, "Aims": True}, {}],
        "a-14": [{"Lifetime cost": 7, "Aims": "y", "Not a field": 1}],
    }
    table = unified_table(publications(spark, files), calendar(spark, []))
    got = {(r["field_name"], r["type"]): r["n"] for r in table_branches(table).collect()}
    w, d = "wlc_baseline_gbp_m", "description"
    assert got == {(w, "number"): 2, (w, "string"): 1, (w, "object"): 1, (d, "array"): 1, (d, "boolean"): 1, (d, "string"): 1}
    assert table_branches(unified_table(publications(spark, {"a-13": [{}]}), calendar(spark, []))).count() == 0


def test_the_one_table_itself_is_a_query(spark, tmp_path):
    publications(spark, {"a-13": [{"WLC approved (£k)": 2500, "Lifetime cost": "£3bn"}, {}]}).write.parquet(str(tmp_path / "publication_rows.parquet"))
    calendar(spark, []).write.parquet(str(tmp_path / "table_calendar_validation.parquet"))
    rows = {r["row_no"]: r for r in drift_queries.QUERIES["p6_rows"](spark, str(tmp_path)).collect()}
    assert len(rows) == 2 and rows[0]["wlc_baseline_gbp_m__string"] == "£3bn" and [m["type"] for m in rows[0]["more"]] == ["number"]
