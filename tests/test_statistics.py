import hashlib
import math
import random
from itertools import combinations, product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from plumbline.operators import documents as DOC
from plumbline.operators import guards, lots, panel, refclass, resample, scoring, variance
from plumbline.operators.link import connected_components
from plumbline.plans import documents as document_queries

pairs = st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.sampled_from([0, 1, None]), st.sampled_from([0.0, 0.1, 0.5, 0.5, 0.9, 1.0, None])), min_size=0, max_size=40)
quick = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def frame(spark, rows):
    return spark.createDataFrame([(g, None if y is None else float(y), p) for g, y, p in rows], "g string, y double, p double")


def auc(rows):
    pos, neg = [p for y, p in rows if y == 1], [p for y, p in rows if y == 0]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


@quick
@given(pairs)
def test_auc_and_bundle_match_brute_force(spark, rows):
    known = [(g, y, p) for g, y, p in rows if y is not None and p is not None]
    got = {r["g"]: r["auc"] for r in scoring.auc_by(frame(spark, rows), ["g"]).collect()}
    bundle = {r["g"]: r for r in scoring.metric_bundle(frame(spark, rows), ["g"]).collect()}
    assert set(got) == set(bundle) == {g for g, _, _ in known}
    for g in got:
        mine = [(y, p) for h, y, p in known if h == g]
        want = auc(mine)
        assert (got[g] is None and want is None) or abs(got[g] - want) < 1e-12
        assert abs(bundle[g]["brier"] - sum((p - y) ** 2 for y, p in mine) / len(mine)) < 1e-12
    numerator = [(auc([(y, p) for h, y, p in known if h == g]), sum(y for h, y, _ in known if h == g) * sum(1 - y for h, y, _ in known if h == g)) for g in "abc"]
    whole = sum(n for a, n in numerator if a is not None)
    strat = scoring.stratified_auc(frame(spark, rows).selectExpr("*", "1 as one"), ["one"], ["g"]).collect()
    if whole:
        assert abs(strat[0]["auc"] - sum(a * n for a, n in numerator if a is not None) / whole) < 1e-12


def test_cross_holder_auc_counts_pairs_across_holders_only(spark):
    rng = random.Random(2)
    rows = [("v", rng.choice("wx"), rng.choice("hij"), rng.choice([0, 1]), round(rng.random(), 1)) for _ in range(120)]
    df = spark.createDataFrame([(a, b, c, float(d), e) for a, b, c, d, e in rows], "all string, vehicle string, holder string, y double, p double")
    got = scoring.cross_holder_auc(df, ["all"], "vehicle", "holder").first()
    wins = [(x[4] > z[4]) + (x[4] == z[4]) / 2 for x, z in product(rows, rows) if x[1] == z[1] and x[2] != z[2] and x[3] == 1 and z[3] == 0]
    assert got["n_pairs"] == len(wins) and abs(got["auc"] - sum(wins) / len(wins)) < 1e-12


def test_murphy_terms_make_the_brier_score_when_bins_are_forecasts(spark):
    rows = frame(spark, [("a", y, p) for y, p in [(1, 0.1), (0, 0.1), (0, 0.4), (1, 0.4), (1, 0.9), (1, 0.9)]])
    binned = scoring.known(rows).groupBy("g", scoring.F.col("p").alias("bin")).agg(scoring.F.count("*").alias("n"), scoring.F.avg("p").alias("mean_p"), scoring.F.avg("y").alias("rate"))
    m, b = scoring.murphy(binned, ["g"]).first(), scoring.metric_bundle(rows, ["g"]).first()
    assert abs(m["reliability"] - m["resolution"] + m["uncertainty"] - b["brier"]) < 1e-12
    assert len(scoring.calibration_fixed(rows, ["g"]).collect()) == 10 and scoring.calibration_fixed(rows.limit(0), ["g"]).count() == 0


def test_spearman_needs_three_rows_and_two_values(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("b", 1.0, 1.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 1.0), ("c", 2.0, 2.0), ("c", 3.0, 2.0), ("c", None, 3.0)], "g string, x double, y double")
    got = {r["g"]: r["spearman"] for r in scoring.spearman_by(df, ["g"], "x", "y").collect()}
    assert got["a"] is None and got["b"] is None and abs(got["c"] - 0.8660254) < 1e-6


def test_within_cell_pairs_match_enumeration(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("xy"), rng.choice("abc"), float(rng.randrange(5)), rng.choice([0, 1, None]), rng.randrange(4)) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, cell string, k string, s double, y int, b int")
    got = lots.within_cell_pairs(df, ["cell"], "k", "s", "y", "b", 1).first()
    right = [(p[3] > n[3]) + (p[3] == n[3]) / 2 for p, n in product(rows, rows) if p[1] == n[1] and p[2] != n[2] and p[4] == 1 and n[4] == 0 and abs(p[5] - n[5]) <= 1]
    assert got["n_pairs"] == len(right) and got["n_right"] == sum(right)
    assert lots.within_cell_pairs(df.limit(0), ["cell"], "k", "s", "y", "b", 1).first()["n_pairs"] == 0


def test_reference_classes(spark):
    train = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 0.0), ("a", "y", 1.0), ("b", "x", 0.0), ("b", "x", None)], "k string, l string, y double")
    test = spark.createDataFrame([("a", "x"), ("c", "z"), (None, "x")], "k string, l string")
    got = {(r["k"], r["l"]): (r["cell_n"], r["prediction"]) for r in refclass.shrunken_means(train, test, ["k", "l"], "y", 2.0).collect()}
    assert got["a", "x"] == (2, (1 + 2 * 0.5) / 4) and got["c", "z"] == (0, 0.5) and got[None, "x"] == (0, 0.5)
    levels = [["k"], ["k", "l"]]
    means = refclass.level_means(train, levels, "y", 2.0)
    out = {(r["k"], r["l"]): (r["level"], r["prediction"]) for r in refclass.predict_levels(test, levels, means, scoring.F.lit(0.5)).collect()}
    parent = (2 + 2 * 0.5) / 5
    assert out["c", "z"] == (-1, 0.5) and out["a", "x"][0] == 1 and abs(out["a", "x"][1] - (1 + 2 * parent) / 4) < 1e-12


def test_offsets_keep_gaps_and_absence_needs_coverage(spark):
    df = spark.createDataFrame([("p", 0, "d", 1), ("p", 2, "d", 3), ("q", 0, "d", 5), ("q", 1, "d", 6), ("r", 0, "e", 7)], "k string, i int, body string, v int")
    got = {(r["k"], r["i"]): (r["v_1"], r["present_1"]) for r in panel.offset_values(df, "k", "i", ["v"], 1, "_1").collect()}
    assert got["p", 0] == (None, False) and got["q", 0] == (6, True)
    absent = {(r["k"], r["i"]): (r["absent_next"], r["exits"]) for r in panel.absences(df, "k", "i", "body").collect()}
    assert absent["p", 0] == (True, False) and absent["q", 1] == (True, True) and absent["r", 0] == (None, None) and absent["p", 2] == (None, None)


def test_variance_components(spark):
    df = spark.createDataFrame([("all", g, float(v)) for g, vs in {"a": (1, 2, 3), "b": (5, 6, 7), "c": (9, 9, 9)}.items() for v in vs], "b string, g string, v double")
    m = variance.intraclass(variance.between_variance(variance.group_moments(df, ["b"], "g", "v"))).first()
    msb, msw = 3 * sum((x - 17 / 3) ** 2 for x in (2, 6, 9)) / 2, 4 / 6
    assert abs(m["msb"] - msb) < 1e-9 and abs(m["msw"] - msw) < 1e-9 and abs(m["icc"] - (msb - msw) / (msb + 2 * msw)) < 1e-9 and abs(m["between"] - (msb - msw) / 3) < 1e-9
    state = variance.two_way_demeaned(df.selectExpr("g as f", "cast(v % 2 as string) as s", "v"), "f", "s", "v")
    assert max(abs(r[0]) for r in state.groupBy("s").avg("residual").selectExpr("`avg(residual)`").collect()) < 1e-6


def test_permutations_stay_in_their_block_and_repeat(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(60)], "id int, block int, v double")
    got = resample.permute_within(df, ["block"], "id", "v", 2).collect()
    assert len(got) == 120
    for d, b in product((0, 1), (0, 1, 2)):
        mine = [r for r in got if r["draw"] == d and r["block"] == b]
        assert sorted(r["shuffled"] for r in mine) == sorted(r["v"] for r in mine)
    again = sorted(map(tuple, resample.permute_within(df.repartition(5), ["block"], "id", "v", 2).collect()))
    assert again == sorted(map(tuple, got)) and any(r["v"] != r["shuffled"] for r in got)
    weights = [r["weight"] for r in resample.bootstrap(df, "id", 50).collect()]
    assert abs(sum(weights) / len(weights) - 1) < 0.1
    sample = resample.stratified_sample(df.where("id < 50"), "block", "id", 10)
    assert sample.count() == 10 and {r["block"]: r["count"] for r in sample.groupBy("block").count().collect()} == {0: 4, 1: 3, 2: 3}


def shuffled_rows(plan):
    """Rows that a finished plan wrote to shuffles."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    written = plan.metrics().get("shuffleRecordsWritten")
    own = written.get().value() if name == "ShuffleExchangeExec" and written.isDefined() else 0
    children = plan.children()
    return own + sum(shuffled_rows(children.apply(i)) for i in range(children.size()))


def test_permutations_send_blocks_and_not_draws(spark):
    df = spark.createDataFrame([(i, i % 3, float(i)) for i in range(300)], "id int, block int, v double")
    drawn = resample.permute_within(df, ["block"], "id", "v", 100)
    assert len(drawn.collect()) == 30_000 and shuffled_rows(drawn._jdf.queryExecution().executedPlan()) < 30_000


def test_permutations_are_in_the_order_of_md5_whatever_the_block(spark):
    sizes = {(1.0, "a"): 40, (1.0, "b"): 1, (2.0, "a"): 7, (float("nan"), "a"): 5, (None, "a"): 3, (3.0, None): 2}
    idents = ["", "ö", "x" * 40, "y" * 41, "z" * 70, None] + [str(3**i) for i in range(60)]
    data, at = [], 0
    for (p, q), n in sizes.items():
        for _ in range(n):
            data.append((p, q, idents[at], None if at == 9 else f"v{at}", at))
            at += 1
    df = spark.createDataFrame(data, "p double, q string, id string, v string, n int")
    want = set()
    for draw in range(45):
        for block in {(str(p), q) for p, q in sizes if p is not None and q is not None}:
            held = [r for r in data if (str(r[0]), r[1]) == block and r[2] is not None]
            order = lambda seed: sorted(held, key=lambda r: hashlib.md5(f"{r[2]}#{seed}".encode()).hexdigest())  # noqa: B023, E731
            want |= {(draw, own[4], dealt[3]) for own, dealt in zip(order(-1), order(draw))}
    for most in (0, 6, 1000):
        got = [tuple(r) for r in resample.permute_within(df, ["p", "q"], "id", "v", 45, give=["n"], block_rows=most).collect()]
        assert set(got) == want and len(got) == len(want) == 45 * 52


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (300, 301), (301, 300), (None, 5), (7, None)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[100 + i] for i in range(30)} == {100} and got[200] == 200 and got[301] == 300
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_sets_match_enumeration(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7))]) for i in range(50)]
    df = spark.createDataFrame([*rows, (99, None)], "id int, w array<string>")
    got = {(r["a"], r["b"]) for r in DOC.similar_sets(df, "id", "w", 0.6).collect()}
    first = {}
    for i, w in rows:
        if w:
            first.setdefault(frozenset(w), i)
    want = {tuple(sorted((first[a], first[b]))) for a, b in combinations(first, 2) if len(a & b) / len(a | b) >= 0.6}
    assert got == want


def test_every_name_keeps_its_links_through_its_set(spark, tmp_path):
    names = ["Dornolstead Flood Barrier Project", "Flood Barrier Project, Dornolstead", "DORNOLSTEAD flood-barrier project", "Dornolstead Flood Barrier Project (DFBP)", "Hill Road Scheme", "Hill Road Scheme", " ", None]
    spark.createDataFrame([(n,) for n in names], "project_name string").write.parquet(f"{tmp_path}/panel_duplicates.parquet")
    members = {r["id"]: r["representative"] for r in document_queries.name_jaccard_members(spark, str(tmp_path)).collect()}
    links = {tuple(sorted(p)): 1.0 for p in combinations(members, 2) if members[p[0]] == members[p[1]]}
    for r in document_queries.name_jaccard(spark, str(tmp_path)).collect():
        links |= {tuple(sorted((x, y))): r["similarity"] for x in members for y in members if members[x] == r["a"] and members[y] == r["b"]}
    bags = {n: frozenset("".join(c if c.isalnum() else " " for c in n.lower()).split()) for n in names if n and n.strip()}
    scores = {tuple(sorted((x, y))): round(len(bags[x] & bags[y]) / len(bags[x] | bags[y]), 6) for x, y in combinations(bags, 2)}
    assert set(members) == set(bags) and links == {p: s for p, s in scores.items() if s >= 0.8} and len(links) == 6


def test_best_threshold(spark):
    rng = random.Random(8)
    rows = [("g", rng.randrange(2000, 2006), rng.choice([0, 1])) for _ in range(40)] + [("h", 2000, 1), ("h", None, 0)]
    got = {r["g"]: r["accuracy"] for r in DOC.best_threshold(spark.createDataFrame(rows, "g string, y int, t int"), ["g"], "y", "t").collect()}
    data = [(y, t) for g, y, t in rows if g == "g"]
    want = max(max(a, len(data) - a) for c in range(1999, 2007) for a in [sum((y > c) == t for y, t in data)]) / len(data)
    assert abs(got["g"] - want) < 1e-9 and got["h"] == 1.0


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    with pytest.raises(ValueError, match="at least 3"):
        guards.require_rows(df, "df", 3)
    with pytest.raises(ValueError, match="mapped"):
        guards.require_mapped(df, "i", "s", "m", 0.9)
    with pytest.raises(ValueError, match="missing columns"):
        guards.require_columns(df, ["z"])
    for bad in (None, math.nan, math.inf):
        with pytest.raises(ValueError):
            guards.require_finite(bad, "x")
    with pytest.raises(ValueError):
        guards.require_overlap(df, df.where("i > 5"), "i", "keys")
    assert guards.require_overlap(df, df, "i", "keys", 2) == 2
