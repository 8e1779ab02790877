import datetime as dt
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.functions import parsing as X
from plumbline.operators import sheets, tenders, windows
from plumbline.plans import parsing as queries


def one(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["out"] for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("cell", "kind", "money"),
    [
        ("12.5", "value", 12.5), ("£1,234.5m", "value", 1234.5), ("(3)", "value", -3.0), ("-3", "value", -3.0), ("Low: 1, Mid: 2, High: 4", "range", 2.0), ("Low: 1, High: 4", "range", 2.5), ("Low: 1", "range", 1.0),
        ("withheld - commercial", "withheld", None), ("not yet agreed", "withheld", None), ("about three", "prose", None), ("3 people", "prose", None), ("TBC", "missing", None), ("", "missing", None), (None, "missing", None), ("%", "missing", None),
    ],
)
def test_money(spark, cell, kind, money):
    assert one(spark, [cell], X.money_kind) == [kind] and one(spark, [cell], X.parse_money) == [money]


def test_money_kinds_takes_every_row(spark, tmp_path):
    cells = ["12.5", "£1,234.5m", "(3)", "536.26 million", "158,570 (£000)", "Low: 1, Mid: 2, High: 4", "not published", "about three", "GBP 2,798.57m", "TBC", "", None]
    spark.createDataFrame([(v,) for v in cells], "wlc_baseline_gbp_m string").write.parquet(f"{tmp_path}/panel_duplicates.parquet")
    got = {r["kind"]: (r["n"], r["total"]) for r in queries.money_kinds(spark, str(tmp_path)).collect()}
    assert got == {"value": (5, 12.5 + 1234.5 - 3 + 536.26 + 158570), "range": (1, 2.0), "withheld": (1, None), "prose": (2, None), "missing": (3, None)}


def test_percentages(spark):
    assert one(spark, ["5%", "0.05", "0.5%", "12", "1", "-0.2", "n/a", None], X.parse_percent) == [5.0, 5.0, 0.5, 12.0, 1.0, -20.0, None, None]


def test_file_order_of_dates(spark):
    rows = [("a", "13/02/2020"), ("a", "03/04/2020"), ("b", "02/13/2020"), ("b", "03/04/2020"), ("b", "Low: 01/02/2020, Mid: 02/03/2020, High: x"), ("b", "00:00:00"), ("b", None), ("a", "02/13/2020")]
    df = spark.createDataFrame(rows, "f string, d string")
    day, month = X.order_votes(F.col("d"))
    votes = df.groupBy("f").agg((F.count_if(month) > F.count_if(day)).alias("m"))
    got = {(r["f"], r["d"]): r["x"] for r in X.with_parsed_date(df.join(votes, "f"), "d", F.col("m"), "x").collect()}
    D = dt.date
    assert got["a", "03/04/2020"] == D(2020, 4, 3) and got["b", "03/04/2020"] == D(2020, 3, 4) and got["b", "02/13/2020"] == D(2020, 2, 13) and got["b", "00:00:00"] is None
    assert got["a", "13/02/2020"] == D(2020, 2, 13) and got["a", "02/13/2020"] is None or got["a", "02/13/2020"] == D(2020, 2, 13)
    assert got["b", "Low: 01/02/2020, Mid: 02/03/2020, High: x"] == D(2020, 2, 3)


def test_date_orders_reads_every_writing(spark, tmp_path):
    rows = [
        ("a", "13/02/2020"), ("a", "03/04/2020"), ("a", "2024-08-27"), ("a", "20280221"), ("a", "02.04.2017"), ("a", "10-Jan-17"), ("a", "16 December 2030"), ("a", "TBC"), ("a", None),
        ("b", "2021-05-06"), ("b", "n/a"), ("c", None), (None, "02/13/2020"), (None, "03/04/2020"),
    ]
    spark.createDataFrame(rows, "publication_slug string, end_date string").write.parquet(f"{tmp_path}/panel_duplicates.parquet")
    got = {r["publication_slug"]: tuple(r)[1:] for r in queries.date_orders(spark, str(tmp_path)).collect()}
    D = dt.date
    assert got == {"a": (1, 0, 7, D(2030, 12, 16)), "b": (0, 0, 1, D(2021, 5, 6)), "c": (0, 0, 0, None), None: (0, 1, 2, D(2020, 3, 4))}


def test_scales_and_instants(spark):
    assert one(spark, ["Negligible-to-Low", "modest", "High", "Satisfactory", None], X.four_point) == [1, 2, 4, None, None]
    assert one(spark, ["modest", "moderate", "High", "x"], X.risk_vintage) == ["new", "old", "both", None]
    at = one(spark, ["2020-01-01T00:30:00+02:00", "2020-01-01T00:30:00.123456+03:00", "2019-12-31T22:30:00Z", "x", None], lambda c: F.unix_micros(X.to_instant(c)))
    assert at[0] == at[2] and at[1] - at[0] == -3600 * 10**6 + 123456 and at[3:] == [None, None]
    assert one(spark, ["2020-01-01T00:30:00+02:00"], lambda c: X.local_date(X.to_instant(c))) == [dt.date(2020, 1, 1)]
    assert one(spark, ["UA-2020-02-03-0001-a", "XX-2020-02-03", None], X.date_in_identifier) == [dt.date(2020, 2, 3), None, None]
    assert one(spark, ["as at March 2014 and", "none", None], X.month_of_statement) == [dt.date(2014, 3, 31), None, None]


def test_windows_tile(spark):
    days = windows.day_windows(spark, "2024-03-30", "2024-04-02", 1).collect()
    assert [round((r["to_instant"] - r["from_instant"]).total_seconds() / 3600) for r in days] == [24, 23, 24]
    months = windows.month_windows(spark, "2023-11-15", "2024-02-01").collect()
    assert [r["month_start"].month for r in months] == [11, 12, 1] and all(a["month_end"] == b["month_start"] for a, b in zip(months, months[1:], strict=False))
    rows = spark.createDataFrame([(y,) for y in [2003] * 5 + [2008] * 4 + [2012] * 2 + [None]], "y int")
    assert windows.adaptive_cut(rows, "y", 2005, 2010, 4) == {"train_end": 2005, "valid_end": 2007, "n_train": 5, "n_valid": 0, "n_test": 6}


def workbook(*sheets_):
    out = io.BytesIO()
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Project</t></si><si><r><t>De</t></r><r><t>partment</t></r></si></sst>")
        for i, rows in enumerate(sheets_, 1):
            body = "".join("<row>" + "".join(f'<c r="{chr(65 + k)}{j}" t="s"><v>{v[1:]}</v></c>' if str(v).startswith("#") else f'<c r="{chr(65 + k)}{j}"><v>{v}</v></c>' for k, v in enumerate(r) if v is not None) + "</row>" for j, r in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def test_sheets(spark, tmp_path):
    (tmp_path / "wide.xlsx").write_bytes(workbook([["notes"]], [["Title"], ["#0", "#1", "Cost", "Cost"], ["A", None, 3, 4], ["B", "d", 5, None]]))
    (tmp_path / "tall.xlsx").write_bytes(workbook([["#0", "A", "B"], ["#1", "d", "e"], ["Start", 1, None]]))
    (tmp_path / "bad.xlsx").write_bytes(b"no workbook")
    cells = sheets.best_sheets(sheets.read_workbooks(spark, str(tmp_path)))
    got = {(r["path"].rsplit("/", 1)[1], r["record_no"], r["header"]): r["value"] for r in sheets.wide_records(cells).collect()}
    assert got == {
        ("wide.xlsx", 0, "Project"): "A", ("wide.xlsx", 0, "Cost"): "3", ("wide.xlsx", 0, "Cost__2"): "4", ("wide.xlsx", 1, "Project"): "B", ("wide.xlsx", 1, "Department"): "d", ("wide.xlsx", 1, "Cost"): "5",
        ("tall.xlsx", 0, "Project"): "A", ("tall.xlsx", 1, "Project"): "B", ("tall.xlsx", 0, "Department"): "d", ("tall.xlsx", 1, "Department"): "e", ("tall.xlsx", 0, "Start"): "1",
    }


def test_lots_and_registry(spark):
    bid = lambda i, who, status, **x: {"id": i, "status": status, "tenderers": [{"identifier": {"id": who}}], **x}
    tender = {
        "id": "t", "lots": [{"id": "l1"}],
        "bids": [
            bid("b1", "X", "active", lotValues=[{"relatedLot": "l1", "value": {"amount": 5}}]), bid("b2", "Y", "active", lotValues={"relatedLot": "l1", "value": {"amount": 7}}),
            bid("b3", "Z", "deleted", lotValues=[{"relatedLot": "l1", "value": {"amount": 1}}]), bid("b4", "W", "active", lotValues=[{"relatedLot": "l1", "value": {}}]),
        ],
        "awards": [{"id": "a1", "status": "unsuccessful", "bid_id": "b1", "lotID": "l1"}, {"id": "a2", "status": "active", "bid_id": "b2", "lotID": "l1"}],
        "contracts": [{"id": "c1", "status": "active", "value": {"amount": 7}}, {"id": "c2", "status": "active"}],
    }
    plain = {"id": "u", "bids": [bid("b5", "X", "active", value={"amount": 3})], "awards": {"id": "a3", "status": "active", "bid_id": "b5"}}
    registry = {"id": "c1", "changes": [{"id": "k1", "date": "2020-01-02T00:00:00Z", "rationaleTypes": ["taxRate", "durationExtension"]}, {"id": "k2", "date": "2020-01-01T00:00:00Z", "rationaleTypes": "taxRate"}]}
    rows = [(i, d["id"], "k", "2020-01-01T00:00:00Z", dt.datetime(2020, 1, 1), json.dumps(d)) for i, d in enumerate((tender, plain, registry))]
    found = tenders.tender_rows(spark.createDataFrame(rows, "record_id long, object_id string, doc_kind string, date_modified string, fetched_at timestamp_ntz, body string"))
    lots = {r["lot_id"]: r for r in tenders.lots_with_winners(found).collect()}
    assert lots["l1"]["n_bids"] == 2 and lots["l1"]["winner_id"] == "Y" and lots["l1"]["winner_rank"] == 2 and lots["l1"]["lowest_disqualified"] and lots["u"]["winner_amount"] == 3.0
    contracts = {r["contract_id"]: r for r in tenders.contracts_with_registry(found).collect()}
    assert contracts["c1"]["n_changes"] == 2 and contracts["c1"]["rationales"] == "durationExtension|taxRate" and contracts["c1"]["n_duration_changes"] == 1
    assert contracts["c1"]["first_change"] < contracts["c1"]["first_duration_change"] and contracts["c2"]["n_changes"] is None


def tender_frame(spark, *documents):
    rows = [(i, d["id"], "k", "2020-01-01T00:00:00Z", dt.datetime(2020, 1, 1), json.dumps(d)) for i, d in enumerate(documents)]
    return tenders.tender_rows(spark.createDataFrame(rows, "record_id long, object_id string, doc_kind string, date_modified string, fetched_at timestamp_ntz, body string"))


def test_what_names_no_lot_belongs_to_the_only_one(spark):
    one = {"id": "t", "tenderID": "T", "lots": [{"id": "l"}], "bids": [{"id": "b", "value": {"amount": 3}}, {"id": "c", "value": None}], "awards": [{"id": "a", "status": "active", "bid_id": "b"}]}
    two = {"id": "u", "tenderID": "U", "lots": [{"id": "m"}, {"id": "n"}], "bids": [{"id": "d", "value": {"amount": 4}}], "awards": [{"id": "a", "status": "active", "bid_id": "d"}]}
    none = {"id": "v", "tenderID": "V", "value": {"amount": 8}, "bids": [{"id": "e", "value": {"amount": 6}}], "awards": [{"status": "active", "bid_id": "e"}]}
    got = {r["bid_id"]: (r["lot_id"], r["won_lot"], r["discount"]) for r in tenders.bids_by_lot(tender_frame(spark, one, two, none)).collect()}
    assert got == {"b": ("l", True, None), "d": ("u", True, None), "e": ("v", True, 0.25)}


def test_states_of_bids_and_the_last_active_award(spark):
    price = lambda x: [{"relatedLot": "l", "value": {"amount": x}}]
    states = {"b1": "invalid", "b2": "pending", "b3": "deleted", "b4": "draft", "b5": "invalid.pre-qualification", "b6": None}
    doc = {
        "id": "t", "tenderID": "T", "lots": [{"id": "l", "value": {"amount": 10}}, {"id": "m"}], "items": [{"relatedLot": "l", "classification": {"id": "45000000-1"}}, {"relatedLot": "l", "classification": {"id": "33000000-1"}}, {"classification": {"id": "33000000-1"}}],
        "bids": [{"id": b, "status": s, "lotValues": price(i)} for i, (b, s) in enumerate(states.items(), 1)],
        "awards": [{"id": "x", "status": "active", "bid_id": "b1", "lotID": "l"}, {"id": "y", "status": "active", "bid_id": "b2", "lotID": "l"}, {"id": "z", "status": "unsuccessful", "bid_id": "b6", "lotID": "l"}],
        "contracts": [{"id": "k", "awardID": "y", "value": {"amount": 2, "amountNet": 2}, "period": {"endDate": "2020-01-01T00:00:00Z"}}, {"id": "j", "awardID": "y", "status": "cancelled", "dateSigned": "2021-01-01"}],
    }
    registry = {"id": "k", "status": "terminated", "value": {"amount": 3, "amountNet": 3}, "amountPaid": {"amount": 1}, "period": {"endDate": "2020-05-01T00:00:00Z"}, "changes": [{"date": "2020-02-01T00:00:00Z", "status": "active", "rationaleTypes": ["durationExtension"]}, {"rationaleTypes": [" taxRate", "taxRate "]}]}
    rows = tender_frame(spark, doc, registry)
    bids = {r["bid_id"]: r for r in tenders.bids_by_lot(rows).collect()}
    assert {b: r["rank_in_lot"] for b, r in bids.items()} == {"b1": 1, "b2": 2, "b3": None, "b4": None, "b5": None, "b6": 3}
    assert [b for b, r in bids.items() if r["won_lot"]] == ["b2"] and [b for b, r in bids.items() if r["disqualified"]] == ["b6"] and bids["b2"]["discount"] == 0.8
    lots = {r["lot_id"]: r for r in tenders.lot_frame(rows).collect()}
    # the first met of equally frequent codes; all items where a lot has none
    assert (lots["l"]["division"], lots["m"]["division"], lots["l"]["only_lot"]) == ("45", "33", False)
    change = tenders.registry_rows(rows).first()
    assert (change["n_changes"], change["n_tax_rate"], change["n_duration_extension"], change["first_change"]) == (2, 1, 1, None) and change["first_duration_change"] is not None
    label = {r["lot_id"]: r for r in tenders.lot_outcomes(rows).collect()}["l"]
    assert (label["contract_id"], label["duration_extension"], label["days_extended_gt90"], label["value_growth_gt10"], label["cancelled"], label["underexecuted"]) == ("k", 1, 1, 1, 0, 1)
    assert tenders.tenders(rows).first()["n_bids"] == 3 and tenders.lot_outcomes(rows.limit(0)).count() == 0
