import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import exprs as E
from plumbline.functions import parsing as X
from plumbline.operators import boosting as G
from plumbline.operators import models as M
from plumbline.operators import ranks as R
from plumbline.operators import resample as B
from plumbline.operators.records import flatten, match_by_id_then_name


def sample(n, seed=1):
    rng = np.random.default_rng(seed)
    x, z = rng.normal(size=n), rng.normal(size=n)
    code = rng.choice([f"c{i}" for i in range(300)] + [None], n)
    gap = rng.random(n) < 0.2
    weight = np.array([0 if c is None else (int(c[1:]) % 7) - 3 for c in code])
    return pd.DataFrame({"x": np.where(gap, np.nan, x), "z": z, "code": code, "margin": np.where(gap, 1.5, np.sign(x)) + 0.6 * weight})


def test_chances_of_held_out_rows():
    frame = sample(6000)
    y = (np.random.default_rng(2).random(6000) < 1 / (1 + np.exp(-frame["margin"]))).astype(float)
    binner = G.Binner(["x", "z"], ["code"]).fit(frame[:3000], y[:3000].to_numpy())
    codes = binner.codes_of(frame)
    model = G.Booster().fit(codes[:3000], y[:3000].to_numpy(), codes[3000:4500], y[3000:4500].to_numpy())
    p = model.score(codes[4500:])
    truth = 1 / (1 + np.exp(-frame["margin"][4500:].to_numpy()))
    held = y[4500:].to_numpy()
    assert 0 < len(model.trees) < G.ROUNDS and np.mean((p - held) ** 2) < 0.8 * np.mean((y[:3000].mean() - held) ** 2) and np.corrcoef(p, truth)[0, 1] > 0.8


@pytest.mark.parametrize("tau", [0.1, 0.5, 0.9])
def test_quantiles_of_held_out_rows(tau):
    frame = sample(6000, 3)
    y = frame["margin"].to_numpy() + np.random.default_rng(4).normal(size=6000)
    binner = G.Binner(["x", "z"], ["code"]).fit(frame[:3000], y[:3000])
    codes = binner.codes_of(frame)
    model = G.Booster(tau).fit(codes[:3000], y[:3000], codes[3000:4500], y[3000:4500])
    q = model.score(codes[4500:])
    assert abs(np.mean(y[4500:] <= q) - tau) < 0.06 and model.loss(q, y[4500:]) < 0.85 * model.loss(np.full(1500, np.quantile(y[:3000], tau)), y[4500:])


def test_groups_fit_and_score(spark):
    frame = sample(1200, 5)
    frame["code"] = [None if pd.isna(c) else f"c{int(c[1:]) % 7}" for c in frame["code"]]
    frame["y"], frame["id"], frame["g"] = (frame["margin"] > 0).astype(float), range(1200), ["a", "b", "c"] * 400
    frame["split"] = np.where(frame["g"] == "c", "test", np.array(["train", "train", "val", "test"])[np.arange(1200) // 3 % 4])
    rows = spark.createDataFrame(frame.drop(columns="margin"))
    models = G.fit_groups(rows, ["g"], "id", "split", "y", ["x", "z"], ["code"], rounds=25)
    assert sorted(r["g"] for r in models.select("g").collect()) == ["a", "b"]
    scored = G.predict_groups(rows.where("split = 'test'"), models, ["g"], ["x", "z"], ["code"]).select("y", F.col("forecasts")[0].alias("p")).toPandas()
    assert len(scored) == 200 and np.mean((scored["p"] - scored["y"]) ** 2) < 0.2
    assert G.fit_groups(rows.limit(0), ["g"], "id", "split", "y", ["x"], []).count() == 0


def test_ranks_totals_and_quantiles_match_pandas(spark):
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"g": rng.choice(["a", "b", None], 900), "v": np.where(rng.random(900) < 0.1, np.nan, np.round(rng.normal(size=900) * 10.0 ** rng.integers(-3, 6, 900), 3))})
    rows = spark.createDataFrame([(i, None if g is None else g, None if np.isnan(v) else float(v)) for i, (g, v) in enumerate(zip(frame["g"], frame["v"]))], "i int, g string, v double")
    ranked = R.average_ranks(rows, ["g"], "v", "r").toPandas().set_index("i")["r"]
    for name, method in (("r", "average"), ("m", "min")):
        got = ranked if name == "r" else R.competition_ranks(rows, ["g"], "v", "m").toPandas().set_index("i")["m"]
        want = frame.assign(g=frame["g"].fillna("?")).groupby("g")["v"].rank(method=method).dropna()
        assert np.allclose(got.sort_index(), want.sort_index())
    quantiles = {r["g"]: r["q"] for r in R.exact_quantiles(rows, ["g"], "v", [0.0, 0.37, 0.5, 1.0], "q").collect()}
    for g, part in frame.assign(g=frame["g"].fillna("?")).groupby("g"):
        assert np.allclose(quantiles[None if g == "?" else g], part["v"].dropna().quantile([0.0, 0.37, 0.5, 1.0]))
    values = sorted(v for v in frame["v"] if not np.isnan(v))
    kinds = [r["k"] for r in spark.createDataFrame([(float(v),) for v in values], "v double").select("v", R.value_range(F.col("v")).alias("k")).orderBy("v").collect()]
    assert kinds == sorted(kinds)
    assert R.average_ranks(rows.limit(0), ["g"], "v", "r").count() == R.exact_quantiles(rows.where("v is null"), ["g"], "v", [0.5], "q").count() == 0


def test_isotonic_levels_match_pooling(spark):
    rng = np.random.default_rng(8)
    rows = [("a", int(l), float(y)) for l, y in zip(rng.integers(0, 9, 300), rng.random(300))] + [("b", 1, 1.0), ("b", 2, 0.0), ("b", None, 1.0), ("b", 3, None)]
    got = {(r["g"], r["l"]): r["fitted"] for r in M.isotonic_levels(spark.createDataFrame(rows, "g string, l int, y double"), ["g"], "l", "y").collect()}
    frame = pd.DataFrame(rows[:300], columns=["g", "l", "y"]).groupby("l")["y"].agg(["size", "mean"])
    n, m = frame["size"].to_numpy(), frame["mean"].to_numpy()
    want = [max(min(np.average(m[i : k + 1], weights=n[i : k + 1]) for k in range(j, len(m))) for i in range(j + 1)) for j in range(len(m))]
    assert np.allclose([got["a", l] for l in frame.index], want) and got["b", 1] == got["b", 2] == 0.5 and len(got) == len(want) + 2


def test_steps_and_masked_shuffles(spark):
    steps = spark.createDataFrame([(0.1,), (0.25,), (0.5,), (9.0,), (None,)], "v double").select(M.isotonic_step(F.col("v"), ([0.2, 0.5], [0.3, 0.7])).alias("s")).collect()
    assert [r["s"] for r in steps] == [0.3, 0.3, 0.7, 0.7, None]
    rows = spark.createDataFrame([(i, i % 2, f"v{i}", i < 12) for i in range(20)], "id int, b int, v string, m boolean")
    out = B.permute_masked(rows, F.col("m"), ["b"], "id", "v", 2).collect()
    assert len(out) == 40 and all(r["v"] == r["shuffled"] for r in out if r["id"] >= 12)
    for d in (0, 1):
        for b in (0, 1):
            dealt = sorted(r["shuffled"] for r in out if (r["draw"], r["b"]) == (d, b))
            assert dealt == sorted(f"v{i}" for i in range(20) if i % 2 == b)


def test_outcome_pairs_and_header_positions(spark):
    texts = [
        "x Ratings ICR IEG Reason Outcome Satisfactory Moderately Satisfactory", "Ratings  ICR\nIEG Comment Moderately Highly Outcome Unsatisfactory Satisfactory", "Ratings ICR IEG Moderately Outcome Satisfactory Satisfactory", "Outcome Satisfactory Satisfactory", None,
    ]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.outcome_pair(F.col("t")).alias("p")).orderBy("i").collect()
    assert [(r["p"]["own"], r["p"]["reviewed"]) for r in rows] == [("Satisfactory", "Moderately Satisfactory"), ("Moderately Unsatisfactory", "Highly Satisfactory"), (None, None), (None, None), (None, None)]
    heads = [["Project", "Budget narrative 2013/14", "2015/16 Baseline (real prices)", "Forecast 2014-15", "Budget 2016/17"], ["Budget 1999/00"], [], None]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, h array<string>").select("i", X.snapshot_of_headers(F.col("h")).alias("d")).orderBy("i").collect()
    assert [None if r["d"] is None else r["d"].isoformat() for r in got] == ["2014-09-30", None, None, None]
    one = spark.createDataFrame([(" ICT ", "BEIS/DBT", "A", "2"), ("", "HMT", "B", "5"), (None, None, "D", None)], "c string, d string, k string, n string")
    out = one.select(E.canonical_category(F.col("c")).alias("c"), E.linking_group(F.col("d")).alias("d"), E.is_competed(F.col("k"), F.col("n")).alias("k")).collect()
    assert [tuple(r) for r in out] == [("ICT", "BEIS lineage", True), (None, "HMT", False), (None, None, False)]


def test_records_flatten(spark):
    record = {"id": 7, "tags": ["a ", "b"], "more": {"x": 1}, "ratings": [{"v": 1, "at": "2020"}, {"at": "2020", "v": 1}, {"at": "2018", "v": 2}, 3], "keyed": {"0": {"at": "b"}, "1": {"at": "a"}}, "nested": {"p": {"q": "r", "s": None}, "t": "u", "w": " "}}
    rows = spark.createDataFrame([(1, json.dumps(record)), (2, "no json"), (3, None), (4, "[1]")], "i int, j string")
    got = {r["i"]: r for r in flatten(rows, "j", ["i"], ["id", "tags", "more", "gone"], {"ratings": "at", "keyed": "at", "none": "at"}, ["nested"]).collect()}
    r = got[1]
    assert (r["id"], r["tags"], json.loads(r["more"]), r["gone"], r["ratings_n"], r["ratings_n_raw"], r["keyed_n"], r["none_n"], r["nested"]) == ("7", "a,b", {"x": 1}, None, 2, 4, 2, 0, "r; u")
    assert json.loads(r["ratings_first"])["v"] == 2 and json.loads(r["ratings_last"])["v"] == 1 and json.loads(r["keyed_first"]) == {"at": "a"} and r["none_first"] is None
    assert all(got[i]["id"] is None and got[i]["ratings_n"] == 0 for i in (2, 3, 4))


def test_matches_by_identifier_then_single_name(spark):
    left = spark.createDataFrame([(1, "s", "A", "x"), (2, "s", "Z", "y"), (3, "s", None, "twice"), (4, "s", None, None), (5, "t", "A", "y")], "i int, b string, k string, n string")
    right = spark.createDataFrame([(10, "s", "A", "other"), (11, "s", None, "y"), (12, "s", None, "twice"), (13, "s", "B", "twice")], "i int, b string, k string, n string")
    got = {r["i"]: (r["matched_by"], r["right_i"]) for r in match_by_id_then_name(left, right, ["b"], "k", "n", ["i"]).collect()}
    assert got == {1: ("id", 10), 2: ("name", 11), 3: (None, None), 4: (None, None), 5: (None, None)}
