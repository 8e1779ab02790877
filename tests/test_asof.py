import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators.asof import as_of_latest, known_attributes

DAY = dt.datetime(2020, 1, 1)


def brute(events, versions):
    out = []
    for k, t, e in events:
        known = [v for v in versions if k is not None and t is not None and v[0] == k and v[1] is not None and v[2] is not None and max(v[1], v[2]) <= t]
        out.append((e, max((v[1], v[2], v[3]) for v in known)[2] if known else None))
    return sorted(out, key=str)


def run(spark, events, versions, **hot):
    e = spark.createDataFrame(events, "k string, t timestamp_ntz, e int")
    v = spark.createDataFrame(versions, "k string, valid timestamp_ntz, rec timestamp_ntz, id int, e string")
    got = as_of_latest(
        e, v, key=["k"], event_time="t", rank=["valid", "rec", "id"], keep=["e"],
        available_at=F.when(F.col("valid").isNotNull() & F.col("rec").isNotNull(), F.greatest("valid", "rec")), **hot,
    )
    assert got.columns == ["k", "t", "e", "version"]
    return sorted(((r["e"], r["version"]["id"] if r["version"] else None) for r in got.collect()), key=str)


@pytest.mark.parametrize("hot", [{}, {"hot_factor": 0.0, "min_hot_rows": 5}])
def test_matches_brute_force_with_and_without_shards(spark, hot):
    rng = random.Random(3)
    def when():
        return None if rng.random() < 0.05 else DAY + dt.timedelta(hours=rng.randrange(60))
    def key():
        return rng.choice(["hot"] * 6 + ["a", "b", None])
    versions = [(key(), when(), when(), i % 40, "x") for i in range(120)]
    events = [(key(), when(), i) for i in range(150)]
    assert run(spark, events, versions + versions[:20], **hot) == brute(events, versions)


@pytest.mark.parametrize("hot", [{}, {"hot_factor": 0.0, "min_hot_rows": 1}])
def test_empty_tables(spark, hot):
    assert run(spark, [], [("a", DAY, DAY, 1, "x")], **hot) == []
    assert run(spark, [("a", DAY, 1), (None, DAY, 2)], [], **hot) == [(1, None), (2, None)]


@pytest.mark.parametrize("spread", [1, 2, 30])
def test_a_third_of_all_rows_under_one_key_at_one_instant(spark, spread):
    """Hot by load alone: an instant that takes several pieces is dealt by event, each piece with the same carry-in."""
    rng = random.Random(spread)
    versions = [("hot", DAY, DAY + dt.timedelta(hours=rng.randrange(spread)), i, "x") for i in range(1500)] + [(f"k{i % 700}", DAY, DAY, i, "x") for i in range(3000)]
    events = [("hot", DAY + dt.timedelta(hours=rng.randrange(spread)), i) for i in range(2500)] + [(f"k{i % 900}", DAY, 5000 + i) for i in range(4000)]
    assert run(spark, events, versions) == brute(events, versions)
    left = spark.createDataFrame(events, "k string, t timestamp_ntz, e int")
    right = spark.createDataFrame(versions, "k string, valid timestamp_ntz, rec timestamp_ntz, id int, e string")
    plan = as_of_latest(left, right, key=["k"], event_time="t", rank=["valid", "rec", "id"], keep=[], available_at=F.greatest("valid", "rec"))
    assert plan._jdf.queryExecution().analyzed().toString().count("Window") == 2


def test_boundary_is_inclusive_and_later_recordings_are_unseen(spark):
    versions = [("a", DAY, DAY, 1, "x"), ("a", DAY, DAY + dt.timedelta(days=2), 2, "y")]
    events = [("a", DAY, 1), ("a", DAY + dt.timedelta(days=1), 2), ("a", DAY + dt.timedelta(days=2), 3)]
    assert run(spark, events, versions) == [(1, 1), (2, 1), (3, 2)]


def test_known_attributes_handles_nulls_and_redelivery(spark):
    d = dt.date(2020, 1, 1)
    p = spark.createDataFrame(
        [(1, "aw", None, "l", 12, DAY), (1, "aw", None, "l", 12, DAY), (2, None, "v", "l", 12, DAY), (3, "aw", "v", "l", None, None)],
        "prediction_id long, contract_award_unique_key string, vehicle string, label string, horizon int, predicted_at timestamp_ntz",
    )
    g = spark.createDataFrame([(5, "v", "l", 12, None, d, DAY)] * 2, "version_id long, vehicle string, label string, horizon int, n_holders int, valid_from date, recorded_at timestamp_ntz")
    a = spark.createDataFrame([(7, "aw", d, 3.0, DAY), (8, "aw", d, None, DAY), (9, "aw", None, 1.0, DAY)], "action_id long, contract_award_unique_key string, action_date date, potential_total_value_of_award double, last_modified_date timestamp_ntz")
    r = spark.createDataFrame([("P", d), ("P", d), ("Q", None)], "projectid string, boardapprovaldate date")
    x = spark.createDataFrame([(1, "P", " Sector", "s", d, d), (2, "P", "status", "s", d, d), (3, "P", "sector", None, d, d)], "version_id long, projectid string, column_name string, value_text string, valid_from date, recorded_on date")
    k = spark.createDataFrame([("sector", True), ("status", False), (None, True)], "column_name string, known_at_board_approval boolean")
    got = {tuple(row) for row in known_attributes(p, g, a, r, x, k).collect()}
    assert got == {("potential_total_value_of_award", "1", 7, "3.0"), ("n_holders", "2", 5, None), ("sector", "P", 1, "s")}
    assert known_attributes(p.limit(0), g.limit(0), a.limit(0), r.limit(0), x.limit(0), k.limit(0)).count() == 0
