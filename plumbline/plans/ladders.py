"""Queries of nested rungs, cross-fitting and refitted or structural nulls."""

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import refclass as R
from ..operators import resample as B
from ..operators import scoring as S
from ..session import table

CELL = ["label", "horizon"]
LEVELS = [["label"], CELL, [*CELL, "agency"], [*CELL, "agency", "vehicle"]]


def _known(spark, sf_dir):
    rows = S.known(table(spark, sf_dir, "predictions").distinct())
    return rows.withColumn("agency", E.agency_of_key(F.col("contract_award_unique_key")))


def nested_ladder(spark, sf_dir):
    """Brier on test rows of every rung of a reference class that gets finer, coarser rungs filling its gaps."""
    rows = _known(spark, sf_dir)
    train, test = rows.where("split = 'train'"), rows.where("split = 'test'")
    means = R.level_means(train, LEVELS, "y", 30.0)
    scored = test
    for depth, (keys, cells) in enumerate(zip(LEVELS, means, strict=True)):
        scored = scored.join(cells.select(*keys, f"m_{depth}"), keys, "left")
    rungs = F.array(*[F.struct(F.lit(d).alias("rung"), F.coalesce(*[F.col(f"m_{k}") for k in range(d, -1, -1)]).alias("q")) for d in range(len(LEVELS))])
    return scored.select("y", F.inline(rungs)).where("q is not null").groupBy("rung").agg(F.count("*").alias("n"), F.round(S.brier("y", "q"), 6).alias("brier"))


def cross_fitted_means(spark, sf_dir):
    """Training rows forecast by their cell's mean over the other four of five folds dealt by md5."""
    rows = _known(spark, sf_dir).where("split = 'train'").withColumn("fold", F.conv(F.substring(B.draw_key(F.col("prediction_id"), 5), 1, 6), 16, 10).cast("bigint") % 5)
    folds = rows.groupBy(*CELL, "fold").agg(F.count("*").alias("fn"), F.sum("y").alias("fs"))
    cells = folds.groupBy(*CELL).agg(F.sum("fn").alias("cn"), F.sum("fs").alias("cs"))
    fitted = rows.join(folds, [*CELL, "fold"]).join(cells, CELL).where("cn > fn").withColumn("q", (F.col("cs") - F.col("fs")) / (F.col("cn") - F.col("fn")))
    return fitted.groupBy(*CELL).agg(F.count("*").alias("n"), F.round(S.brier("y", "q"), 6).alias("brier"))


def refit_placebo(spark, sf_dir):
    """Cell means refitted on shuffled training outcomes, ten times: AUC on test rows per draw."""
    rows = _known(spark, sf_dir)
    train = rows.where("split = 'train'").select("label", "agency", "prediction_id", "y")
    drawn = B.permute_within(train.select("label", "prediction_id", "y"), ["label"], "prediction_id", "y", 10).join(train.select("prediction_id", "agency"), "prediction_id")
    means = drawn.where("agency is not null").groupBy("draw", "label", "agency").agg(F.round(F.avg("shuffled"), 9).alias("q"))
    test = rows.where("split = 'test'").select("label", "agency", "y").join(means, ["label", "agency"])
    return S.auc_by(test, ["label", "draw"], "y", "q").select("label", "draw", F.round("auc", 6).alias("auc"))


def structural_null(spark, sf_dir):
    """AUC of a rank for \"the next rank is lower\" when next ranks are redrawn: what the outcome's make-up alone gives."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("now"), F.lit("all").alias("block"))
    following = table(spark, sf_dir, "orders").select((F.col("o_orderkey") - 1).alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("next"))
    both = rows.join(following, "id")
    drawn = B.permute_within(both.select("block", "id", "next"), ["block"], "id", "next", 5).join(both.select("id", "now"), "id")
    null = drawn.select(F.concat(F.lit("draw "), F.col("draw").cast("string")).alias("series"), "now", F.col("shuffled").alias("next"))
    real = both.select(F.lit("observed").alias("series"), "now", "next")
    scored = real.unionByName(null).withColumn("y", (F.col("next") < F.col("now")).cast("double")).withColumn("p", F.col("now").cast("double"))
    return S.auc_by(scored, ["series"]).select("series", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


QUERIES = {f.__name__: f for f in (nested_ladder, cross_fitted_means, refit_placebo, structural_null)}

_P = "ok as (select distinct *, nullif(regexp_extract(contract_award_unique_key, '_([^_]+)$', 1), '') as agency from predictions where y is not null and p is not null)"
_AUC = "round((cast(sum(rk) filter (y = 1) as double) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) as auc"
SQL = {
    "nested_ladder": f"""with {_P}, t as (select * from ok where split = 'train'), g as (select avg(y) as base from t),
      l0 as (select label, (sum(y) + 30 * max(base)) / (count(*) + 30) as m0 from t, g group by 1), l1 as (select label, horizon, (sum(y) + 30 * avg(m0)) / (count(*) + 30) as m1 from t join l0 using (label) group by 1, 2),
      l2 as (select label, horizon, agency, (sum(y) + 30 * avg(m1)) / (count(*) + 30) as m2 from t join l1 using (label, horizon) group by 1, 2, 3),
      l3 as (select label, horizon, agency, vehicle, (sum(y) + 30 * avg(m2)) / (count(*) + 30) as m3 from t join l2 using (label, horizon, agency) group by 1, 2, 3, 4),
      s as (select y, m0, coalesce(m1, m0) as q1, coalesce(m2, m1, m0) as q2, coalesce(m3, m2, m1, m0) as q3 from ok left join l0 using (label) left join l1 using (label, horizon) left join l2 using (label, horizon, agency) left join l3 using (label, horizon, agency, vehicle) where split = 'test'),
      u as (select y, unnest([0, 1, 2, 3]) as rung, unnest([m0, q1, q2, q3]) as q from s)
      select rung, count(*) as n, round(avg((q - y) * (q - y)), 6) as brier from u where q is not null group by 1""",
    "cross_fitted_means": f"""with {_P}, t as (select *, cast('0x' || substr(md5(cast(prediction_id as varchar) || '#5'), 1, 6) as bigint) % 5 as fold from ok where split = 'train'), f as (select label, horizon, fold, count(*) as fn, sum(y) as fs from t group by 1, 2, 3),
      c as (select label, horizon, sum(fn) as cn, sum(fs) as cs from f group by 1, 2), q as (select t.label, t.horizon, y, (cs - fs) / (cn - fn) as q from t join f using (label, horizon, fold) join c using (label, horizon) where cn > fn)
      select label, horizon, count(*) as n, round(avg((q - y) * (q - y)), 6) as brier from q group by 1, 2""",
    "refit_placebo": f"""with {_P}, d as (select label, agency, prediction_id as id, y, cast(unnest(range(10)) as int) as draw from ok where split = 'train'), a as (select *, row_number() over (partition by draw, label order by md5(cast(id as varchar) || '#-1'), id) as k from d),
      b as (select draw, label, y as z, row_number() over (partition by draw, label order by md5(cast(id as varchar) || '#' || cast(draw as varchar)), id) as k from d), m as (select draw, label, agency, round(avg(z), 9) as q from a join b using (draw, label, k) where agency is not null group by 1, 2, 3),
      s as (select m.draw, label, y, q from ok join m using (label, agency) where split = 'test'), r as (select *, rank() over (partition by draw, label order by q) + (count(*) over (partition by draw, label, q) - 1) / 2.0 as rk from s)
      select label, draw, {_AUC} from r group by 1, 2""",
    "structural_null": f"""with o as (select o_orderkey as id, cast(substr(o_orderpriority, 1, 1) as int) as now from orders), x as (select a.id, a.now, b.now as next from o a join o b on b.id = a.id + 1),
      d as (select *, cast(unnest(range(5)) as int) as draw from x), a as (select *, row_number() over (partition by draw order by md5(cast(id as varchar) || '#-1'), id) as k from d), b as (select draw, next as z, row_number() over (partition by draw order by md5(cast(id as varchar) || '#' || cast(draw as varchar)), id) as k from d),
      u as (select 'observed' as series, now as p, cast(next < now as double) as y from x union all select 'draw ' || cast(draw as varchar), now, cast(z < now as double) from a join b using (draw, k)),
      r as (select *, rank() over (partition by series order by p) + (count(*) over (partition by series, p) - 1) / 2.0 as rk from u) select series, sum(y) as n_pos, sum(1 - y) as n_neg, {_AUC} from r group by 1""",
}
