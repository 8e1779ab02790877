"""Queries that fit models; their results are properties of fits, so they have no SQL."""

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import boosting as G
from ..operators import ledger as L
from ..operators import models as M
from ..operators import scoring as S
from ..operators.ranks import exact_quantiles
from ..session import table

NUMERIC = ["log_base_obligation", "log_base_ceiling", "option_heaviness", "planned_duration_days", "number_of_offers_received", "recipient_prior_award_count", "office_prior_slip_rate"]
CODES = ["naics2", "psc1", "type_of_contract_pricing_code", "extent_competed_code", "awarding_agency_code"]


def _panel(spark, sf_dir):
    panel = L.award_panel(table(spark, sf_dir, "action_ledger")).withColumn("split", E.split_of(F.col("base_fy"))).withColumn("y", F.col("schedule_slip_gt90_36"))
    return panel.where("y is not null and qualifies_36 and split is not null").select(L.KEY, "split", "y", *NUMERIC, *CODES).persist()


def gbt_ladder(spark, sf_dir):
    """Base rate, reference class and boosted trees on test awards: Brier, skill, AUC."""
    from ..operators.refclass import shrunken_means

    panel = _panel(spark, sf_dir)
    train, val, test = (panel.where(F.col("split") == s) for s in ("train", "val", "test"))
    fitted = M.fit_boosted(train, val, NUMERIC, CODES, "y")
    base = train.agg(F.avg("y")).first()[0] or 0.0
    scored = M.predict_boosted(fitted, shrunken_means(train, test, ["awarding_agency_code", "naics2"], "y", 20.0), NUMERIC)
    each = F.array(
        *[F.struct(F.lit(n).alias("rung"), c.alias("p")) for n, c in (("base rate", F.lit(base)), ("reference class", F.col("prediction")), ("boosted trees", F.col("forecast")))]
    )
    long = scored.select("y", F.inline(each)).withColumn("reference", F.lit(base))
    scores = long.groupBy("rung").agg(F.count("*").alias("n"), S.brier().alias("brier"), S.skill(S.brier(), F.avg(F.pow(F.col("reference") - F.col("y"), F.lit(2)))).alias("skill"))
    return scores.join(S.auc_by(long, ["rung"]).select("rung", "auc"), "rung")


def permutation_importance(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    fitted = M.fit_boosted(panel.where("split = 'train'"), panel.where("split = 'val'"), NUMERIC, CODES, "y")
    test = panel.where("split = 'test'")
    rows = [(c, float(M.permutation_importance(fitted, test, NUMERIC, c, L.KEY, "y"))) for c in ("planned_duration_days", "log_base_ceiling")]
    return spark.createDataFrame(rows, "feature string, brier_rise double")


def partial_dependence(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    fitted = M.fit_boosted(panel.where("split = 'train'"), panel.where("split = 'val'"), NUMERIC, CODES, "y")
    return M.partial_dependence(fitted, panel.where("split = 'test'"), NUMERIC, "number_of_offers_received", [1.0, 2.0, 3.0, 5.0, 8.0, 15.0])


def text_logit(spark, sf_dir):
    """Project outcome from the project's documents, fitted on odd and scored on even approval years."""
    from ..operators.documents import latest_rating

    rated = latest_rating(table(spark, sf_dir, "rated_projects")).where("boardapprovaldate is not null").select("projectid", F.year("boardapprovaldate").alias("yr"), E.label_at_least(E.six_point(F.col("ieg_outcome")), 4).alias("y"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "projectid", "text").join(rated, "projectid").where("y is not null").persist()
    fitted = M.fit_text(rows.where("yr % 2 = 1"), "y")
    scored = M.predict_text(fitted, rows.where("yr % 2 = 0")).select(F.lit("text").alias("rung"), "y", F.col("forecast").alias("p"))
    return S.metric_bundle(scored, ["rung"]).join(S.auc_by(scored, ["rung"]).select("rung", "auc"), "rung")


def isotonic_step(spark, sf_dir):
    """Forecasts recalibrated by a step function fitted on training rows, scored on test rows."""
    rows = S.known(table(spark, sf_dir, "predictions").distinct())
    knots = M.fit_isotonic(rows.where("split = 'train'"), "p", "y")
    test = rows.where("split = 'test'").withColumn("q", M.isotonic_step(F.col("p"), knots))
    return test.groupBy("label").agg(F.count("*").alias("n"), F.round(S.brier(), 6).alias("brier"), F.round(S.brier("y", "q"), 6).alias("recalibrated"))


HISTORY = ("recipient_prior_award_count", "office_prior_slip_rate")


def _cells(spark, sf_dir):
    """Awards of every label and horizon as rows of (label, horizon, y), with features at the award's start."""
    panel = L.award_panel(table(spark, sf_dir, "action_ledger")).withColumn("split", E.split_of(F.col("base_fy"))).where("split is not null")
    each = [F.struct(F.lit(name).alias("label"), F.lit(h).alias("horizon"), F.when(F.col(f"qualifies_{h}"), F.col(f"{name}_{h}").cast("double")).alias("y")) for name in ("schedule_slip_gt90", "ceiling_growth_gt25") for h in (12, 24, 36)]
    return panel.select(L.KEY, "split", *NUMERIC, *CODES, F.inline(F.array(*each))).where("y is not null")


def booster_ladder(spark, sf_dir):
    """Per label and horizon the Brier score on test awards of the training rate, and of trees without and with histories."""
    rows = _cells(spark, sf_dir)
    cell = ["label", "horizon"]
    plain = [c for c in NUMERIC if c not in HISTORY]
    base = rows.where("split = 'train'").groupBy(*cell).agg(F.avg("y").alias("p"))
    test = rows.where("split = 'test'")
    scored = test.join(base, cell).select(*cell, F.lit("base rate").alias("rung"), "y", "p")
    for rung, numeric in (("trees", plain), ("trees with history", NUMERIC)):
        models = G.fit_groups(rows, cell, L.KEY, "split", "y", numeric, CODES)
        scored = scored.unionByName(G.predict_groups(test, models, cell, numeric, CODES).select(*cell, F.lit(rung).alias("rung"), "y", F.col("forecasts")[0].alias("p")))
    return S.metric_bundle(scored, [*cell, "rung"]).join(S.auc_by(scored, [*cell, "rung"]).select(*cell, "rung", "auc"), [*cell, "rung"])


def quantile_boosters(spark, sf_dir):
    """Pinball losses on test awards of training quantiles and of boosted ones, for the log of the base obligation, cut at
    the training rows' 1st and 99th percentile."""
    panel = L.award_panel(table(spark, sf_dir, "action_ledger")).withColumn("split", E.split_of(F.col("base_fy"))).where("split is not null and log_base_obligation is not null")
    numeric = [c for c in NUMERIC if c != "log_base_obligation"]
    rows = panel.select(L.KEY, "split", *numeric, *CODES, F.col("log_base_obligation").alias("raw"), F.lit("obligation").alias("target"))
    cut = exact_quantiles(rows.where("split = 'train'"), ["target"], "raw", [0.01, 0.1, 0.5, 0.9, 0.99], "q")
    rows = rows.join(F.broadcast(cut), "target").withColumn("y", F.greatest(F.col("q")[0], F.least("raw", F.col("q")[4])))
    levels = (0.1, 0.5, 0.9)
    models = G.fit_groups(rows.drop("q"), ["target"], L.KEY, "split", "y", numeric, CODES, levels)
    scored = G.predict_groups(rows.where("split = 'test'"), models, ["target"], numeric, CODES)
    each = F.array(*[F.struct(F.lit(t).alias("tau"), F.col("q")[i + 1].alias("constant"), F.col("forecasts")[i].alias("boosted")) for i, t in enumerate(levels)])
    long = scored.select("y", F.inline(each))
    loss = lambda c: F.avg(F.greatest(F.col("tau") * (F.col("y") - F.col(c)), (F.col("tau") - 1) * (F.col("y") - F.col(c))))
    return long.groupBy("tau").agg(F.count("*").alias("n"), loss("constant").alias("constant_loss"), loss("boosted").alias("boosted_loss"))


QUERIES = {f.__name__: f for f in (booster_ladder, quantile_boosters, gbt_ladder, permutation_importance, partial_dependence, text_logit, isotonic_step)}
SQL = {}
