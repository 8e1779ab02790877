import numpy as np
import pytest

from plumbline.llm import mixing as mixing_module
from plumbline.llm.abuse import Model, Words, document_features, fit_model, isotonic, plain_word, score_documents, sentence_features
from plumbline.llm.mixing import mix, mix_report, solve

DOCS = "doc_id long, text string, source string, grp string"
TARGETS = "source string, target_share double, max_repeats int"


def test_flow_meets_quotas_and_spreads_repetition():
    groups = {("a",): 100, ("b",): 100, ("a", "b"): 50}
    total, flows = solve(groups, {"a": (0.5, 1), "b": (0.5, 2)}, None)
    assert total in (300, 301) and sum(v for (g, s), v in flows.items() if s == "a") == 150
    assert flows["a",] if ("a",) in flows else flows[(("a",), "a")] == 100
    total, flows = solve({("a",): 10}, {"a": (0.5, 3), "b": (0.5, 1)}, 100)
    assert flows == {(("a",), "a"): 30}
    assert solve({}, {"a": (1.0, 1)}, None) == (0, {})


def corpus(spark, sizes, extra=()):
    rows, i = [], 0
    for source, n in sizes.items():
        for k in range(n):
            i += 1
            rows.append((i, f"{source} number {i} says {'word ' * (k % 7)}end", source, "x"))
    return spark.createDataFrame([*rows, *extra], DOCS)


def test_mix(spark):
    extra = [(900, None, "a", None), (901, "", "a", None), (902, "no source", None, None), (903, "not wanted", "z", None), (904, "a number 1 says end", "a", None), (905, "a number 1 says end", "b", None)]
    docs = corpus(spark, {"a": 300, "b": 200, "c": 20}, extra)
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), (None, 0.1, 1)], TARGETS)
    rows, total = mix(docs, targets)
    got = rows.collect()
    most = {"a": 1, "b": 2, "c": 4}
    assert got and all(0 < r["n_uses"] <= most[r["source"]] for r in got) and len({(r["doc_id"], r["source"]) for r in got}) == len(got)
    tokens = {s: sum(r["n_uses"] * r["n_tokens"] for r in got if r["source"] == s) for s in most}
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(tokens[s] - share * total) <= 60
    again = sorted(map(tuple, mix(docs.orderBy("text"), targets)[0].collect()))
    assert again == sorted(map(tuple, got))


def test_every_document_of_equal_texts_can_be_used(spark):
    """Supply of a source: the tokens of all its documents times its repeats, whoever else has their texts."""
    rows = [(i, f"text {i % 4} is held by many", "a", "x") for i in range(12)] + [(100 + i, f"text {i % 2} is held by many", "b", "x") for i in range(5)] + [(200, "only here", "b", "x"), (200, "only here", "b", "x")]
    docs, most = spark.createDataFrame(rows, DOCS), {"a": 3, "b": 2}
    targets = spark.createDataFrame([("a", 0.7, 3), ("b", 0.3, 2), ("gone", 0.0, 1)], TARGETS)
    got = mix(docs, targets, total_tokens=1_000_000)[0].collect()
    assert {(r["doc_id"], r["source"], r["n_uses"]) for r in got} == {(i, s, most[s]) for i, _, s, _ in rows} and len(got) == 18
    supply = {s: sum(r["n_uses"] * r["n_tokens"] for r in got if r["source"] == s) for s in most}
    part, total = mix(docs, targets)
    part = part.collect()
    assert abs(total - min(supply["a"] / 0.7, supply["b"] / 0.3)) <= 4 and all(0 < r["n_uses"] <= most[r["source"]] for r in part)
    # texts come before further documents with the same text
    few = mix(docs, targets.where("source = 'a'"), total_tokens=int(4 * got[0]["n_tokens"] / 0.7))[0].collect()
    assert {r["doc_id"] for r in few} == {0, 1, 2, 3} and solve({("a",): 10, ("a", "a"): 20}, {"a": (1.0, 2)}, 30)[1] == {(("a",), "a"): 10, (("a", "a"), "a"): 20}


def test_reachable_targets_are_met_although_documents_are_whole(spark):
    """Long documents beside short ones: what they leave open of a quota is filled."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(300 if i % 9 == 0 else 1 + i % 12)), "a" if i % 3 else "b", "x") for i in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.37, 2), ("b", 0.63, 3)], TARGETS)
    report = mix_report(docs, targets).collect()
    assert all(r["met"] for r in report) and max(r["most_uses"] for r in report) <= 3
    assert all(abs(r["n_tokens"] - r["target_share"] * r["total_aimed"]) <= 30 for r in report)


def test_many_sets_of_sources_are_taken_apart(spark, monkeypatch):
    rows = [(10 * i + k, f"text {i}", f"s{k}", "x") for i in range(40) for k in range(4) if (i >> k) & 1]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([(f"s{k}", 0.25, 2) for k in range(4)], TARGETS)
    together = {r["source"]: r["n_tokens"] for r in mix_report(docs, targets).collect()}
    monkeypatch.setattr(mixing_module, "MOST_GROUPS", 3)
    apart = {r["source"]: r["n_tokens"] for r in mix_report(docs, targets).collect()}
    assert set(apart) == set(together) and all(abs(apart[s] - together[s]) <= 3 for s in apart) and all(apart.values())


def test_the_number_of_sets_of_sources_changes_nothing(spark, monkeypatch):
    rows = [(10 * i + k, f"text {i}", f"s{k}", "x") for i in range(40) for k in range(4) if (i >> k) & 1]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([(f"s{k}", 0.25, 2) for k in range(4)], TARGETS)
    below = sorted(map(tuple, mix(docs, targets, total_tokens=60)[0].collect()))
    monkeypatch.setattr(mixing_module, "MOST_GROUPS", 3)
    with pytest.warns(UserWarning, match="sets of sources"):
        above = sorted(map(tuple, mix(docs.repartition(7), targets, total_tokens=60)[0].collect()))
    assert below and above == below


def test_cheapest_flow_matches_brute_force():
    """Least cost over all ways to meet the quotas, where the k-th use of a group costs 2 k, and 1 more for several sources."""
    groups, targets = {("a",): 2, ("b",): 1, ("a", "b"): 2}, {"a": (0.5, 2), "b": (0.5, 2)}
    for total in (4, 6, 8, 10):
        _, flows = solve(groups, targets, total)
        def cost(sent):
            return sum(2 * (u // groups[g]) + (len(g) > 1) for g in groups for u in range(sum(v for (h, _), v in sent.items() if h == g)))
        quota = total // 2
        best = min(
            cost({(("a",), "a"): x, (("a", "b"), "a"): quota - x, (("b",), "b"): y, (("a", "b"), "b"): quota - y})
            for x in range(5) for y in range(3) if 0 <= quota - x <= 4 and 0 <= quota - y <= 4
        )
        assert cost(flows) == best and sum(v for (_, s), v in flows.items() if s == "a") == quota


def test_unreachable_targets_are_reported(spark):
    docs = corpus(spark, {"a": 30, "b": 3})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.4, 2), ("gone", 0.1, 1)], TARGETS)
    report = {r["source"]: r for r in mix_report(docs, targets, total_tokens=10_000).collect()}
    assert report["gone"]["n_tokens"] == 0 and not report["gone"]["met"] and report["b"]["most_uses"] == 2 and report["a"]["n_documents"] == 30
    assert {r["n_tokens"] for r in mix_report(docs.limit(0), targets).collect()} == {0}
    assert mix_report(docs, targets.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("word", "plain", "odd"),
    [("Idiot", "idiot", False), ("iіdіot", "idiot", True), ("b@st4rd", "bastard", True), ("idiooooot", "idiot", True), ("mOroN", "moron", True), ("s****g", "s*g", True), ("crétin", "cretin", False), ("2014", "2014", False)],
)
def test_plain_words(word, plain, odd):
    assert plain_word(word) == (plain, odd)


def test_disguises_in_texts():
    words = Words()
    for text in ("you are an i d i o t here", "you i-d-i-o-t", "you i.d.i.o.t", "you id​iot"):
        sentences = words.sentences(text)
        assert any("idiot" in w for w, _ in sentences) and any(odd for _, odd in sentences), text
    assert words.sentences("") == [] and words.sentences("...") == []


def test_margin_of_lexicons_alone():
    words, model = Words(), Model()
    bad = ["Shut your mouth, you filthy bastard.", "Go to hell, you pathetic little idiot.", "Ferme ta gueule, pauvre crétin.", "Ти жалюгідний ідіот і нікчема."]
    good = ["The dumb waiter in block 3 will be replaced.", "Rats and other vermin were removed from the substation.", "The decision is a disgrace.", None, "", "   "]
    assert (model.score(bad, words) > 0.5).all() and (model.score(good, words) < 0.5).all() and model.score([None, ""], words).tolist() == [0, 0]


def test_isotonic_matches_brute_force():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, 80).astype(float), rng.random(80)
    xs, ys = isotonic(x, y)
    fit = np.interp(x, xs, ys)
    assert (np.diff(ys) >= -1e-12).all() and abs(fit.mean() - y.mean()) < 1e-9
    levels = np.unique(x)
    means = [y[x == v].mean() for v in levels]
    weights = [(x == v).sum() for v in levels]
    best = [max(min(np.average(means[i : k + 1], weights=weights[i : k + 1]) for k in range(j, len(levels))) for i in range(j + 1)) for j in range(len(levels))]
    assert np.allclose(np.interp(levels, xs, ys), best)


def test_learned_model_holds_out(spark):
    rng = np.random.default_rng(2)
    plain = ["The survey of the harbour is complete.", "Payment came after nine days.", "Lot 3 covers cable.", "The board met in April."]
    bad = ["Crawl back under your rock, you {}.", "Nobody would miss such a {} as you.", "What kind of {} writes this to you?"]
    rows, labels = [], []
    for i in range(400):
        parts = list(rng.choice(plain, 3))
        toxic = i % 8 == 0
        if toxic:
            parts.insert(1, str(rng.choice(bad)).format(rng.choice(["zorglub", "moron", "fleebish"])))
        rows.append((i, " ".join(parts), "s", "g"))
        if i < 240:
            seen = int(toxic) if rng.random() > 0.05 else 1 - int(toxic)
            labels.append((i, "r1", seen))
    rows += [(1000, None, None, None), (1001, "", "s", None)]
    docs = spark.createDataFrame(rows, DOCS)
    model = fit_model(docs, spark.createDataFrame(labels, "doc_id long, rater string, toxic int"))
    got = {r["doc_id"]: r["score"] for r in score_documents(docs.select("doc_id", "source", "text"), model).collect()}
    held = range(240, 400)
    hits = [(got[i] >= 0.5) == (i % 8 == 0) for i in held]
    assert np.mean(hits) > 0.97 and got[1000] == got[1001] == 0
    none = fit_model(docs.limit(0), spark.createDataFrame([], "doc_id long, rater string, toxic int"))
    assert none.trees is None and score_documents(docs.limit(0).select("doc_id", "text"), none).count() == 0


def test_features_have_fixed_length():
    words = Words()
    text = "You idiot. " * 3
    assert len(document_features(words.sentences(text), text, {})) == len(document_features([], "", {})) and len(sentence_features(["you"], 0, {})) == 18
