import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import ledger as L
from plumbline.plans import ledger as queries

D = dt.date
SCHEMA = (
    "action_id long, contract_award_unique_key string, modification_number string, transaction_number string, action_date date, action_type_code string, award_type_code string, "
    "federal_action_obligation double, base_and_all_options_value double, base_and_exercised_options_value double, potential_total_value_of_award double, "
    "period_of_performance_start_date date, period_of_performance_current_end_date date, period_of_performance_potential_end_date date, recipient_uei string, recipient_name string, "
    "awarding_agency_code string, awarding_office_code string, naics_code string, product_or_service_code string, type_of_contract_pricing_code string, extent_competed_code string, number_of_offers_received double"
)


def action(i, mod, date, value, key="A", end=D(2013, 1, 1), code=None, uei="U1", office="O1", name="ACME", kind="D", obligation=300_000.0, total=None):
    return (i, key, mod, "0", date, code, kind, obligation, value, value, total, D(2012, 1, 1), end, end, uei, name, "070", office, "541511", "R408", "J", "A", 2.0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


BASE = action(1, "0", D(2012, 1, 31), 1_000_000.0, total=1_900_000.0)
CASE = [
    BASE,
    action(2, "P00001", D(2012, 7, 15), 100_000.0, end=D(2013, 3, 1), code="A"),
    action(3, "P00002", D(2013, 7, 15), 400_000.0, end=D(2013, 7, 1)),
    action(4, "P00003", D(2014, 7, 15), 600_000.0, end=None, code="E"),
]


def labels(spark, rows):
    return {r[L.KEY]: r for r in L.award_labels(frame(spark, rows)).collect()}


def test_growth_at_every_horizon_and_redelivery(spark):
    row = labels(spark, [*CASE, *CASE])["A"]
    assert [row[f"ceiling_growth_{h}"] for h in (12, 24, 36)] == [0.1, 0.5, 1.1]
    assert [row[f"ceiling_growth_gt10_{h}"] for h in (12, 24, 36)] == [0.0, 1.0, 1.0] and row["ceiling_growth_gt50_24"] == 0.0
    assert [row[f"schedule_slip_days_{h}"] for h in (12, 24, 36)] == [59, 181, None] and row["schedule_slip_gt90_36"] is None
    assert [row[f"terminated_{h}"] for h in (12, 24, 36)] == [0, 0, 1] and row["n_actions_by_36"] == 4 and row["change_order_count_12"] == 1
    assert row["award_level_gt25_12"] == 1.0 and row["qualifies_36"]


@pytest.mark.parametrize(("day", "seen"), [(D(2013, 1, 31), True), (D(2013, 2, 1), False)])
def test_the_horizon_day_itself_is_included(spark, day, seen):
    row = labels(spark, [BASE, action(2, "P00001", day, 500_000.0)])["A"]
    assert (row["ceiling_growth_12"] == 0.5) == seen


def test_base_row_choice_and_scope(spark):
    rows = [
        *CASE,
        action(10, "P00001", D(2012, 1, 1), 5.0, key="no base"),
        action(11, "P00001", D(2011, 1, 1), 5.0, key="late base"), action(12, "0", D(2012, 1, 1), 5.0, key="late base"),
        action(13, "0", D(2012, 1, 1), 5.0, key="two"), action(14, "P00000", D(2012, 6, 1), 7.0, key="two"),
        action(15, "0", D(2012, 1, 1), 0.0, key="zero"), action(16, "0", D(2012, 1, 1), 9.0, key="small", obligation=10.0),
        action(17, "0", D(2012, 1, 1), None, key="null"), action(18, "0", D(2012, 1, 1), 9.0, key="other", kind="C"), action(19, "0", None, 9.0, key="undated"), action(20, "0", D(2012, 1, 1), 9.0, key=None),
        action(21, "0", D(2024, 1, 1), 9.0, key="too new"),
    ]
    base = {r[L.KEY]: r for r in L.base_rows(L.load_actions(frame(spark, rows))).collect()}
    assert set(base) == {"A", "no base", "late base", "two", "zero", "small", "null", "too new"}
    assert base["two"]["action_id"] == 13 and base["two"]["n_base_rows"] == 2 and not base["late base"]["base_is_first_action"] and base["no base"]["action_date"] is None
    got = labels(spark, rows)
    assert set(got) == {"A", "two", "zero", "small", "null"} and got["zero"]["ceiling_growth_12"] is None and got["null"]["ceiling_growth_gt25_36"] is None
    assert {r[L.KEY] for r in L.award_panel(frame(spark, rows)).collect()} == {"A"}
    assert L.award_panel(frame(spark, [])).count() == 0


def test_history_is_strictly_earlier_and_resolved(spark):
    rng = random.Random(4)
    rows, i = [], 0
    for k in range(60):
        uei, office, name = rng.choice(["U1", "U2", None]), rng.choice(["O1", "O2", None]), rng.choice(["ACME", "ACME", "MULTIPLE AWARDEES (UNDISCLOSED)"])
        start = D(2011, 1, 1) + dt.timedelta(days=rng.randrange(0, 3000, 150))
        i += 1
        rows.append(action(i, "0", start, 100.0, key=f"k{k}", uei=uei, office=office, name=name))
        if rng.random() < 0.5:
            i += 1
            rows.append(action(i, "P00001", start + dt.timedelta(days=30), float(rng.randrange(200)), key=f"k{k}", uei=uei, office=office, name=name, code=rng.choice(["E", None])))
    plain = L.award_labels(frame(spark, rows))
    known = {r[L.KEY]: r for r in plain.collect()}
    got = {r[L.KEY]: r for r in L.add_history(plain).collect()}
    assert len(got) == len(known) == 60

    def after(d, months):
        y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
        last = (D(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
        return D(y, m + 1, min(d.day, last))

    for key, r in known.items():
        for name, col in (("recipient", "recipient_uei"), ("office", "awarding_office_code")):
            usable = lambda x: x[col] is not None and not (name == "recipient" and "MULTIPLE" in x["recipient_name"])  # noqa: B023, E731
            if not usable(r):
                assert got[key][f"{name}_prior_award_count"] is None and got[key][f"{name}_prior_mean_growth"] is None
                continue
            peers = [x for x in known.values() if usable(x) and x[col] == r[col]]
            assert got[key][f"{name}_prior_award_count"] == sum(x["action_date"] < r["action_date"] for x in peers)
            done = [max(-1.0, min(10.0, x["ceiling_growth_36"])) for x in peers if after(x["action_date"], 36) <= r["action_date"]]
            mean = got[key][f"{name}_prior_mean_growth"]
            assert (mean is None) == (not done) and (not done or abs(mean - sum(done) / len(done)) < 1e-8)


def test_close_actions_of_one_day_follow_the_total_order(spark):
    rows = [BASE, action(3, "P00010", D(2012, 5, 1), 1.0, end=D(2015, 1, 1)), action(2, "P00009", D(2012, 5, 1), 1.0, end=D(2014, 1, 1))]
    assert labels(spark, rows)["A"]["current_end_at_12"] == D(2015, 1, 1)


def test_daily_history_of_one_row_and_nulls(spark):
    df = spark.createDataFrame([("g", D(2020, 1, 1), 1.0), ("g", D(2020, 1, 1), None), ("g", D(2020, 1, 2), None), (None, D(2020, 1, 1), 1.0), ("g", None, 1.0)], "g string, d date, v double")
    got = {r["d"]: r for r in L.daily_history(df, "g", "d", F.col("d"), {"v": F.col("v")}).collect()}
    assert got[D(2020, 1, 1)]["n_before"] == 0 and got[D(2020, 1, 1)]["v_n"] == 1 and got[D(2020, 1, 2)]["n_before"] == 2 and got[D(2020, 1, 2)]["v_mean"] == 1.0


@pytest.mark.parametrize(("years", "gaps"), [([2011, 2012, 2013, 2014, 2016, 2016, None, 2019], {2015, 2017, 2018}), ([2011, 2012, 2013], set()), ([None], set()), ([], set())])
def test_year_gaps_are_those_of_the_whole_ledger(spark, tmp_path, years, gaps):
    spark.createDataFrame([(y,) for y in years], "source_fiscal_year int").write.parquet(f"{tmp_path}/action_ledger.parquet")
    assert {r["fy"] for r in queries.year_gaps(spark, str(tmp_path)).collect()} == gaps
