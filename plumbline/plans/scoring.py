"""Queries that score forecasts."""

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import refclass as R
from ..operators import scoring as S
from ..operators.ranks import exact_quantiles
from ..session import table

CELL = ["label", "horizon"]


def _predictions(spark, sf_dir):
    return table(spark, sf_dir, "predictions").distinct()


def _rounded(df, *names, digits=6):
    """Rounded columns; means of forecasts get a nudge that settles decimal ties alike in every engine."""
    nudge = lambda c: F.col(c) + 1e-12 if c in ("mean_p", "mae") else F.col(c)
    return df.select(*[F.round(nudge(c), digits).alias(c) if c in names else F.col(c) for c in df.columns])


def brier_skill(spark, sf_dir):
    return _rounded(S.metric_bundle(_predictions(spark, sf_dir), CELL), "base_rate", "mean_p", "brier", "skill", "log_loss")


def metric_bundle_by_split(spark, sf_dir):
    return _rounded(S.metric_bundle(_predictions(spark, sf_dir), ["split"]), "base_rate", "mean_p", "brier", "skill", "log_loss")


def skill_against_train_rate(spark, sf_dir):
    """Skill on test rows against the rate of the training rows."""
    rows = S.known(_predictions(spark, sf_dir))
    rate = rows.where("split = 'train'").groupBy(*CELL).agg(F.avg("y").alias("train_rate"))
    test = rows.where("split = 'test'").join(rate, CELL)
    out = test.groupBy(*CELL).agg(
        F.count("*").alias("n"), S.brier().alias("brier"), F.avg(F.pow(F.col("train_rate") - F.col("y"), F.lit(2))).alias("reference")
    )
    return _rounded(out.withColumn("skill", S.skill(F.col("brier"), F.col("reference"))), "brier", "reference", "skill")


def auc_ties(spark, sf_dir):
    rows = _predictions(spark, sf_dir).withColumn("p", F.round("p", 2))
    return _rounded(S.auc_by(rows, CELL), "auc")


def auc_by_group(spark, sf_dir):
    return _rounded(S.auc_by(_predictions(spark, sf_dir), ["split", *CELL]), "auc")


def auc_stratified_pairs(spark, sf_dir):
    return _rounded(S.stratified_auc(_predictions(spark, sf_dir).where("vehicle is not null"), CELL, ["vehicle"]), "auc")


def auc_within_usable(spark, sf_dir):
    rows = _predictions(spark, sf_dir).where("vehicle is not null")
    return _rounded(S.stratified_auc(rows, ["label"], ["vehicle"], min_n=10, min_class=2), "auc")


def auc_cross_holder(spark, sf_dir):
    """Pairs of one vehicle across its holders, a prediction's holder being its award's first recipient."""
    holder = table(spark, sf_dir, "action_ledger").where("recipient_uei is not null").groupBy("contract_award_unique_key").agg(F.min("recipient_uei").alias("holder"))
    rows = _predictions(spark, sf_dir).where("vehicle is not null").join(holder, "contract_award_unique_key")
    return _rounded(S.cross_holder_auc(rows, ["label"], "vehicle", "holder"), "auc")


def calibration_fixed(spark, sf_dir):
    return _rounded(S.calibration_fixed(_predictions(spark, sf_dir), ["label"]), "mean_p", "rate")


def calibration_equal_count(spark, sf_dir):
    return _rounded(S.calibration_equal_count(_predictions(spark, sf_dir), ["label"]), "mean_p", "rate")


def murphy_fixed(spark, sf_dir):
    return _rounded(S.murphy(S.calibration_fixed(_predictions(spark, sf_dir), ["label"]), ["label"]), "reliability", "resolution", "uncertainty", "ece")


def murphy_equal_count(spark, sf_dir):
    return _rounded(S.murphy(S.calibration_equal_count(_predictions(spark, sf_dir), ["label"]), ["label"]), "reliability", "resolution", "uncertainty", "ece")


def murphy_labels(spark, sf_dir):
    """Bins are the distinct forecasts themselves."""
    rows = S.known(_predictions(spark, sf_dir).withColumn("p", F.round("p", 1)))
    binned = rows.groupBy("label", F.col("p").alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))
    return _rounded(S.murphy(binned, ["label"]), "reliability", "resolution", "uncertainty", "ece")


def log_loss_by_year(spark, sf_dir):
    rows = S.known(_predictions(spark, sf_dir)).groupBy(E.fiscal_year(F.col("predicted_at")).alias("fy")).agg(F.count("*").alias("n"), S.log_loss().alias("log_loss"))
    return _rounded(rows, "log_loss")


def pinball_quantiles(spark, sf_dir):
    """Pinball loss of training quantiles on test obligations, winsorised at the training 1 and 99 per cent."""
    base = table(spark, sf_dir, "action_ledger").dropDuplicates(["action_id"]).where("federal_action_obligation > 0").select(
        E.split_of(E.fiscal_year(F.col("action_date"))).alias("split"), F.log10("federal_action_obligation").alias("x")
    )
    found = exact_quantiles(base.where("split = 'train'"), ["split"], "x", [0.01, 0.1, 0.5, 0.9, 0.99], "q").first()
    q = found["q"] if found else [0.0] * 5
    test = base.where("split = 'test'").withColumn("w", F.greatest(F.lit(q[0]), F.least("x", F.lit(q[4]))))
    losses = [
        F.struct(F.lit(t).alias("tau"), F.lit(round(v, 6)).alias("quantile"), F.avg(F.greatest(t * (F.col("w") - v), (t - 1) * (F.col("w") - v))).alias("loss"))
        for t, v in ((0.1, q[1]), (0.5, q[2]), (0.9, q[3]))
    ]
    return _rounded(test.agg(F.array(*losses).alias("l")).select(F.inline("l")), "loss")


def mean_absolute_error(spark, sf_dir):
    rows = S.known(_predictions(spark, sf_dir)).groupBy("horizon").agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y") - F.col("p"))).alias("mae"))
    return _rounded(rows, "mae")


def spearman_ranks(spark, sf_dir):
    rows = table(spark, sf_dir, "exp2_holder_gaps").distinct()
    return _rounded(S.spearman_by(rows, CELL, "train_gap", "recovered_gap"), "spearman")


def weighted_pearson(spark, sf_dir):
    rows = table(spark, sf_dir, "exp2_holder_gaps").distinct().where("oracle_gap is not null and recovered_gap is not null and n_test_orders is not null")
    w = F.col("n_test_orders").cast("double")
    return _rounded(rows.groupBy("label").agg(F.count("*").alias("n"), S.weighted_pearson(F.col("oracle_gap"), F.col("recovered_gap"), w).alias("pearson")), "pearson")


def refclass_flat(spark, sf_dir):
    """Test predictions by (label, horizon, vehicle) cells of the training rows, shrunk by 20 rows."""
    rows = S.known(_predictions(spark, sf_dir))
    out = R.shrunken_means(rows.where("split = 'train'"), rows.where("split = 'test'"), [*CELL, "vehicle"], "y", 20.0)
    return _rounded(out.select("prediction_id", "cell_n", "prediction"), "prediction")


def refclass_hierarchical(spark, sf_dir):
    rows = S.known(_predictions(spark, sf_dir)).withColumn("agency", E.agency_of_key(F.col("contract_award_unique_key")))
    levels = [["label"], CELL, [*CELL, "agency"], [*CELL, "agency", "vehicle"]]
    train = rows.where("split = 'train'")
    means = R.level_means(train, levels, "y", 30.0)
    out = R.predict_levels(rows.where("split = 'test'"), levels, means, F.lit(None).cast("double"))
    return _rounded(out.select("prediction_id", "level", "prediction"), "prediction")


def category_lumping(spark, sf_dir):
    rows = table(spark, sf_dir, "action_ledger").dropDuplicates(["action_id"])
    kept = R.top_categories(rows.where(E.split_of(E.fiscal_year(F.col("action_date"))) == "train"), "product_or_service_code", 12)
    return R.lump(rows, "product_or_service_code", kept).groupBy("product_or_service_code").agg(F.count("*").alias("n"))


def quantile_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "action_ledger").dropDuplicates(["action_id"]).where("federal_action_obligation > 0")
    x = F.round(F.log10("federal_action_obligation"), 8)
    rows = rows.where("award_type_code is not null").withColumn("x", x)
    edges = exact_quantiles(rows, ["award_type_code"], "x", [0.2, 0.4, 0.6, 0.8], "edges").withColumn("edges", F.array_distinct("edges"))
    return (
        rows.join(edges, "award_type_code").groupBy("award_type_code", R.right_open_bin(F.col("x"), F.col("edges")).alias("quintile")).agg(F.count("*").alias("n"))
    )


def choose_shrink_k(spark, sf_dir):
    """Validation Brier of vehicle residuals shrunk by each k of a grid, and the best k per label."""
    rows = S.known(_predictions(spark, sf_dir)).where("vehicle is not null").withColumn("r", F.col("y") - F.col("p"))
    table_ = rows.where("split = 'train'").groupBy("label", "vehicle").agg(F.count("*").alias("n"), F.avg("r").alias("mean")).where("n >= 3")
    val = rows.where("split = 'val'").join(table_, ["label", "vehicle"])
    grid = F.array(*[F.lit(k) for k in (0.0, 5.0, 20.0, 80.0)])
    scored = val.select("label", "y", "p", "n", "mean", F.explode(grid).alias("k")).withColumn(
        "q", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p") + F.col("n") * F.col("mean") / (F.col("n") + F.col("k"))))
    )
    return _rounded(scored.groupBy("label", "k").agg(F.count("*").alias("n"), S.brier("y", "q").alias("brier")), "brier")


def climatology_by_year(spark, sf_dir):
    rows = S.known(_predictions(spark, sf_dir)).withColumn("fy", E.fiscal_year(F.col("predicted_at")))
    return _rounded(R.climatology(rows, "fy", "y"), "climatology")


QUERIES = {
    f.__name__: f
    for f in (
        brier_skill, metric_bundle_by_split, skill_against_train_rate, auc_ties, auc_by_group, auc_stratified_pairs, auc_within_usable, auc_cross_holder,
        calibration_fixed, calibration_equal_count, murphy_fixed, murphy_equal_count, murphy_labels, log_loss_by_year, pinball_quantiles,
        mean_absolute_error, spearman_ranks, weighted_pearson, refclass_flat, refclass_hierarchical, category_lumping, quantile_edges, choose_shrink_k,
        climatology_by_year,
    )
}

_P = "pr as (select distinct * from predictions), ok as (select * from pr where y is not null and p is not null)"
_FY = "year({0}) + case when month({0}) >= 10 then 1 else 0 end"
_BUNDLE = """count(*) as n, round(avg(y), 6) as base_rate, round(avg(p) + 1e-12, 6) as mean_p, round(avg((p - y) * (p - y)), 6) as brier,
  round(1 - avg((p - y) * (p - y)) / nullif(avg(y) * (1 - avg(y)), 0), 6) as skill,
  round(-avg(y * ln(greatest(1e-9, least(p, 1 - 1e-9))) + (1 - y) * ln(1 - greatest(1e-9, least(p, 1 - 1e-9)))), 6) as log_loss"""


def _u(rows, by):
    """CTE text: rank counts of ``rows`` by the columns ``by``."""
    return f"""c as (select {by}, p, sum(y) as pos, sum(1 - y) as neg from {rows} group by {by}, p),
      d as (select *, coalesce(sum(neg) over (partition by {by} order by p rows between unbounded preceding and 1 preceding), 0) as below from c),
      u as (select {by}, sum(pos) as n_pos, sum(neg) as n_neg, sum(pos * (below + neg / 2)) as u from d group by {by})"""


_MURPHY = """w as (select *, sum(n) over (partition by label) as total, sum(n * rate) over (partition by label) / sum(n) over (partition by label) as base from b where n > 0)
  select label, round(sum(n / total * (mean_p - rate) * (mean_p - rate)), 6) as reliability, round(sum(n / total * (rate - base) * (rate - base)), 6) as resolution,
    round(max(base * (1 - base)), 6) as uncertainty, round(sum(n / total * abs(mean_p - rate)), 6) as ece from w group by label"""
_FIXED = "select label, cast(greatest(0, least(floor(round(p * 10, 9)), 9)) as int) as bin, count(*) as n, avg(p) as mean_p, avg(y) as rate from ok group by 1, 2"
_EQUAL = """e as (select label, list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) as edges from ok group by 1),
  q as (select o.label, p, y, cast(greatest(0, len(list_filter(edges, lambda x: x < p)) - 1) as int) as bin from ok o join e on e.label = o.label)"""

SQL = {
    "brier_skill": f"with {_P} select label, horizon, {_BUNDLE} from ok group by 1, 2",
    "metric_bundle_by_split": f"with {_P} select split, {_BUNDLE} from ok group by 1",
    "skill_against_train_rate": f"""with {_P}, r as (select label, horizon, avg(y) as tr from ok where split = 'train' group by 1, 2)
      select label, horizon, count(*) as n, round(avg((p - y) * (p - y)), 6) as brier, round(avg((tr - y) * (tr - y)), 6) as reference,
      round(1 - avg((p - y) * (p - y)) / nullif(avg((tr - y) * (tr - y)), 0), 6) as skill from ok join r using (label, horizon) where split = 'test' group by 1, 2""",
    "auc_ties": f"with {_P}, t as (select * replace (round(p, 2) as p) from ok), {_u('t', 'label, horizon')} select label, horizon, n_pos, n_neg, round(u / nullif(n_pos * n_neg, 0), 6) as auc from u",
    "auc_by_group": f"with {_P}, {_u('ok', 'split, label, horizon')} select split, label, horizon, n_pos, n_neg, round(u / nullif(n_pos * n_neg, 0), 6) as auc from u",
    "auc_stratified_pairs": f"""with {_P}, t as (select * from ok where vehicle is not null), {_u('t', 'label, horizon, vehicle')}
      select label, horizon, count(*) filter (least(n_pos, n_neg) >= 1) as n_strata, count(*) filter (least(n_pos, n_neg) < 1) as n_skipped, sum(n_pos * n_neg) filter (least(n_pos, n_neg) >= 1) as n_pairs,
      round(sum(u) filter (least(n_pos, n_neg) >= 1) / sum(n_pos * n_neg) filter (least(n_pos, n_neg) >= 1), 6) as auc from u group by 1, 2""",
    "auc_within_usable": f"""with {_P}, t as (select * from ok where vehicle is not null), {_u('t', 'label, vehicle')}, f as (select *, n_pos + n_neg >= 10 and least(n_pos, n_neg) >= 2 as good from u)
      select label, count(*) filter (good) as n_strata, count(*) filter (not good) as n_skipped, sum(n_pos * n_neg) filter (good) as n_pairs, round(sum(u) filter (good) / sum(n_pos * n_neg) filter (good), 6) as auc from f group by 1""",
    "auc_cross_holder": f"""with {_P}, h as (select contract_award_unique_key, min(recipient_uei) as holder from action_ledger where recipient_uei is not null group by 1),
      t as (select * from ok join h using (contract_award_unique_key) where vehicle is not null),
      a as (select x.label, sum(case when x.p > z.p then 1 when x.p = z.p then 0.5 else 0 end) as u, count(*) as pairs from t x join t z on x.label = z.label and x.vehicle = z.vehicle and x.holder <> z.holder and x.y = 1 and z.y = 0 group by 1)
      select label, cast(pairs as double) as n_pairs, round(cast(u as double) / pairs, 6) as auc from a""",
    "calibration_fixed": f"""with {_P}, f as ({_FIXED}), g as (select distinct label, cast(unnest(range(10)) as int) as bin from ok)
      select g.label, g.bin, coalesce(n, 0) as n, round(mean_p + 1e-12, 6) as mean_p, round(rate, 6) as rate from g left join f using (label, bin)""",
    "calibration_equal_count": f"with {_P}, {_EQUAL} select label, bin, count(*) as n, round(avg(p) + 1e-12, 6) as mean_p, round(avg(y), 6) as rate from q group by 1, 2",
    "murphy_fixed": f"with {_P}, b as ({_FIXED}), {_MURPHY}",
    "murphy_equal_count": f"with {_P}, {_EQUAL}, b as (select label, bin, count(*) as n, avg(p) as mean_p, avg(y) as rate from q group by 1, 2), {_MURPHY}",
    "murphy_labels": f"with {_P}, b as (select label, round(p, 1) as bin, count(*) as n, avg(round(p, 1)) as mean_p, avg(y) as rate from ok group by 1, 2), {_MURPHY}",
    "log_loss_by_year": f"with {_P} select cast({_FY.format('predicted_at')} as int) as fy, count(*) as n, round(-avg(y * ln(greatest(1e-9, least(p, 1 - 1e-9))) + (1 - y) * ln(1 - greatest(1e-9, least(p, 1 - 1e-9)))), 6) as log_loss from ok group by 1",
    "pinball_quantiles": f"""with r as (select distinct * from action_ledger where federal_action_obligation > 0), b as (select {_FY.format('action_date')} as fy, log10(federal_action_obligation) as x from r),
      q as (select quantile_cont(x, [0.01, 0.1, 0.5, 0.9, 0.99]) as q from b where fy between 2010 and 2017), t as (select greatest(q[1], least(x, q[5])) as w, q from b, q where fy between 2020 and 2022),
      s as (select w, unnest([0.1, 0.5, 0.9]) as tau, unnest([q[2], q[3], q[4]]) as v from t)
      select cast(tau as double) as tau, round(v, 6) as quantile, round(avg(greatest(tau * (w - v), (tau - 1) * (w - v))), 6) as loss from s group by 1, 2""",
    "mean_absolute_error": f"with {_P} select horizon, count(*) as n, round(avg(abs(y - p)) + 1e-12, 6) as mae from ok group by 1",
    "spearman_ranks": """with g as (select distinct * from exp2_holder_gaps where train_gap is not null and recovered_gap is not null),
      r as (select label, horizon, rank() over (partition by label, horizon order by train_gap) + (count(*) over (partition by label, horizon, train_gap) - 1) / 2.0 as rx,
        rank() over (partition by label, horizon order by recovered_gap) + (count(*) over (partition by label, horizon, recovered_gap) - 1) / 2.0 as ry from g)
      select label, horizon, count(*) as n, case when count(*) >= 3 then round(corr(cast(rx as double), cast(ry as double)), 6) end as spearman from r group by 1, 2""",
    "weighted_pearson": """with g as (select distinct * from exp2_holder_gaps where oracle_gap is not null and recovered_gap is not null and n_test_orders is not null),
      s as (select label, count(*) as n, cast(sum(n_test_orders) as double) as sw, sum(n_test_orders * oracle_gap) as sx, sum(n_test_orders * recovered_gap) as sy, sum(n_test_orders * oracle_gap * recovered_gap) as sxy,
        sum(n_test_orders * oracle_gap * oracle_gap) as sxx, sum(n_test_orders * recovered_gap * recovered_gap) as syy from g group by 1)
      select label, n, round((sxy / sw - sx / sw * sy / sw) / sqrt((sxx / sw - sx / sw * sx / sw) * (syy / sw - sy / sw * sy / sw)), 6) as pearson from s""",
    "refclass_flat": f"""with {_P}, b as (select avg(y) as base from ok where split = 'train'), c as (select label, horizon, vehicle, count(*) as n, sum(y) as s from ok where split = 'train' group by 1, 2, 3)
      select prediction_id, coalesce(n, 0) as cell_n, round(case when n is not null then (s + 20 * base) / (n + 20) else base end, 6) as prediction
      from ok t cross join b left join c on c.label = t.label and c.horizon = t.horizon and c.vehicle = t.vehicle where t.split = 'test'""",
    "refclass_hierarchical": f"""with {_P}, r as (select *, nullif(regexp_extract(contract_award_unique_key, '_([^_]+)$', 1), '') as agency from ok), t as (select * from r where split = 'train'), g as (select avg(y) as base from t),
      l0 as (select label, (sum(y) + 30 * max(base)) / (count(*) + 30) as m0 from t, g group by 1),
      l1 as (select label, horizon, (sum(y) + 30 * avg(m0)) / (count(*) + 30) as m1 from t join l0 using (label) group by 1, 2),
      l2 as (select label, horizon, agency, (sum(y) + 30 * avg(m1)) / (count(*) + 30) as m2 from t join l1 using (label, horizon) group by 1, 2, 3),
      l3 as (select label, horizon, agency, vehicle, (sum(y) + 30 * avg(m2)) / (count(*) + 30) as m3 from t join l2 using (label, horizon, agency) group by 1, 2, 3, 4)
      select prediction_id, case when m3 is not null then 3 when m2 is not null then 2 when m1 is not null then 1 when m0 is not null then 0 else -1 end as level, round(coalesce(m3, m2, m1, m0), 6) as prediction
      from r left join l0 using (label) left join l1 using (label, horizon) left join l2 using (label, horizon, agency) left join l3 using (label, horizon, agency, vehicle) where split = 'test'""",
    "category_lumping": f"""with r as (select distinct * from action_ledger), k as (select coalesce(product_or_service_code, '__NULL__') as v, count(*) as n from r where {_FY.format('action_date')} between 2010 and 2017 group by 1 order by n desc, v limit 12)
      select case when coalesce(product_or_service_code, '__NULL__') in (select v from k) then coalesce(product_or_service_code, '__NULL__') else '__OTHER__' end as product_or_service_code, count(*) as n from r group by 1""",
    "quantile_edges": """with r as (select distinct * from action_ledger where federal_action_obligation > 0), x as (select award_type_code, round(log10(federal_action_obligation), 8) as x from r),
      e as (select award_type_code, list_distinct(quantile_cont(x, [0.2, 0.4, 0.6, 0.8])) as edges from x group by 1)
      select award_type_code, cast(len(list_filter(edges, lambda z: z <= x)) as varchar) as quintile, count(*) as n from x join e using (award_type_code) group by 1, 2""",
    "choose_shrink_k": f"""with {_P}, r as (select *, y - p as r from ok where vehicle is not null), t as (select label, vehicle, count(*) as n, avg(r) as m from r where split = 'train' group by 1, 2 having count(*) >= 3),
      s as (select label, y, p, n, m, unnest([0.0, 5.0, 20.0, 80.0]) as k from r join t using (label, vehicle) where split = 'val'), q as (select *, greatest(0, least(1, p + n * m / (n + k))) as q from s)
      select label, cast(k as double) as k, count(*) as n, round(avg((q - y) * (q - y)), 6) as brier from q group by 1, 2""",
    "climatology_by_year": f"""with {_P}, s as (select cast({_FY.format('predicted_at')} as int) as fy, count(*) as n, sum(y) as s from ok group by 1),
      w as (select fy, coalesce(sum(n) over b, 0) as nb, sum(s) over b as sb from s window b as (order by fy rows between unbounded preceding and 1 preceding))
      select fy, cast(nb as bigint) as n_before, round(case when nb >= 20 then sb / nb end, 6) as climatology from w""",
}
