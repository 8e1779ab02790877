"""Queries over snapshot panels, variance between groups, and resampling."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import panel as P
from ..operators import resample as B
from ..operators import variance as V
from ..operators.ranks import exact_quantiles
from ..operators.scoring import auc_by, correlation, spearman_by
from ..session import table

TYPES = ["click", "purchase", "view", "signup", "scroll"]


def _panel(spark, sf_dir):
    """Users by day: the sum of values and the last event of the day; a user's body is its id modulo seven."""
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).alias("idx")).agg(
        F.sum(F.col("value").cast("decimal(20,6)")).alias("total"), F.max_by("event_type", F.struct("ts", "event_id")).alias("rating"), F.count("*").alias("n_events")
    ).withColumn("body", F.pmod("user_id", F.lit(7)))


def _rounded(df, *names, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


def snapshot_forward(spark, sf_dir):
    panel = _panel(spark, sf_dir)
    ahead = P.offset_values(P.offset_values(panel, "user_id", "idx", ["total", "rating"], 1, "_1"), "user_id", "idx", ["total"], 2, "_2")
    growth = F.try_divide(F.col("total_1").cast("double"), F.nullif(F.col("total").cast("double"), F.lit(0.0))) - 1
    return ahead.select("user_id", "idx", "present_1", "present_2", F.round(growth, 6).alias("growth_1"), (F.col("rating_1") != F.col("rating")).alias("rating_changed"))


def snapshot_absence(spark, sf_dir):
    return P.absences(_panel(spark, sf_dir), "user_id", "idx", "body").groupBy("idx").agg(
        F.count("*").alias("n"), F.count_if("absent_next").alias("n_absent_next"), F.count_if(F.col("absent_next").isNull()).alias("n_unknown"), F.count_if("exits").alias("n_exits")
    )


def previous_rating(spark, sf_dir):
    back = P.offset_values(_panel(spark, sf_dir), "user_id", "idx", ["rating"], -1, "_before")
    return back.groupBy(F.col("rating_before").alias("before"), F.col("rating").alias("now")).agg(F.count("*").alias("n"))


def persistence_forecast(spark, sf_dir):
    """How often the rating before is the rating now, per day."""
    back = P.offset_values(_panel(spark, sf_dir), "user_id", "idx", ["rating"], -1, "_before").where("rating_before is not null")
    return back.groupBy("idx").agg(F.count("*").alias("n"), F.round(F.avg((F.col("rating") == F.col("rating_before")).cast("double")), 6).alias("hit_rate"))


def rating_crosstab(spark, sf_dir):
    kinds = P.column_values(table(spark, sf_dir, "events"), "event_type")
    out = P.cross_tab(_panel(spark, sf_dir), "body", "rating", kinds)
    return out.select("body", F.inline(F.array(*[F.struct(F.lit(k).alias("rating"), F.col(f"`{k}`").alias("n")) for k in kinds])))


def exit_buckets(spark, sf_dir):
    """Leavers by how far before the end they left, and the median total of leavers and stayers."""
    rows = P.absences(_panel(spark, sf_dir), "user_id", "idx", "body").where("exits is not null")
    bucket = F.when(~F.col("exits"), "stays").when(F.col("idx") >= 28, "last days").when(F.col("idx") >= 21, "last week").otherwise("earlier")
    rows = rows.select(bucket.alias("bucket"), F.col("total").cast("double").alias("total"))
    middle = exact_quantiles(rows, ["bucket"], "total", [0.5], "q")
    return rows.groupBy("bucket").agg(F.count("*").alias("n")).join(middle, "bucket", "left").select("bucket", "n", F.round(F.col("q")[0], 6).alias("median_total"))


def coverage_table(spark, sf_dir):
    return _panel(spark, sf_dir).groupBy("idx").agg(
        F.count("*").alias("n_users"), F.count_if(F.col("n_events") > 1).alias("n_several"), F.count_distinct("body").alias("n_bodies"), F.count_distinct("rating").alias("n_ratings")
    )


def offset_gaps(spark, sf_dir):
    """Gaps between a user's neighbouring positions."""
    w = Window.partitionBy("user_id").orderBy("idx")
    return _panel(spark, sf_dir).withColumn("gap", F.col("idx") - F.lag("idx").over(w)).where("gap is not null").groupBy("gap").agg(F.count("*").alias("n"))


def first_observed(spark, sf_dir):
    """A user's first total, and how its last compares."""
    return _panel(spark, sf_dir).groupBy("user_id").agg(F.min_by("total", "idx").cast("double").alias("first_total"), F.max_by("total", "idx").cast("double").alias("last_total"), F.count("*").alias("n"))


def conflict_dedupe(spark, sf_dir):
    """Lines with one order and line number: equal ones are kept once, contradicting ones are numbered."""
    rows = table(spark, sf_dir, "lineitem")
    sig = F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    out = P.conflict_dedupe(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), ["l_orderkey", "l_linenumber"], sig, [F.col("l_shipdate")])
    return out.groupBy("variant").agg(F.count("*").alias("n"), F.sum("n_copies").alias("n_rows"))


def _residuals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", (F.col("l_returnflag") == "R").cast("double").alias("y"), (F.col("l_discount") * 10).alias("p"),
        F.when(F.col("l_shipdate") < F.lit("1999-01-01"), "train").otherwise("test").alias("split"),
    ).withColumn("r", F.col("y") - F.col("p"))


def anova_components(spark, sf_dir):
    out = V.between_variance(V.group_moments(_residuals(spark, sf_dir), ["split"], "l_suppkey", "r"))
    return _rounded(out.select("split", "k", "n", "msb", "msw", "n0", "between", "share"), "msb", "msw", "n0", "between", "share")


def icc(spark, sf_dir):
    out = V.intraclass(V.group_moments(_residuals(spark, sf_dir), ["split"], "l_suppkey", "y", least=3))
    return _rounded(out.select("split", "k", "n", "icc"), "icc")


def cross_period_cov(spark, sf_dir):
    """Covariance and correlation of suppliers' mean residuals before and after 1999."""
    wide = _residuals(spark, sf_dir).groupBy("l_suppkey").agg(
        F.avg(F.when(F.col("split") == "train", F.col("r"))).alias("a"), F.avg(F.when(F.col("split") == "test", F.col("r"))).alias("b"), F.count("*").alias("n")
    )
    out = wide.where("a is not null and b is not null").agg(F.count("*").alias("n"), F.covar_pop("a", "b").alias("cov"), correlation("a", "b").alias("corr"))
    return _rounded(out, "cov", "corr", digits=8)


def split_half(spark, sf_dir):
    """Suppliers' rows dealt into two halves in md5 order: covariance of the halves' means."""
    key = B.draw_key(F.concat_ws("/", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")], F.date_format("l_shipdate", "yyyy-MM-dd")), 0)
    rows = _residuals(spark, sf_dir).withColumn("half", F.conv(F.substring(key, 1, 1), 16, 10).cast("int") % 2)
    wide = rows.groupBy("l_suppkey").agg(F.avg(F.when(F.col("half") == 0, F.col("r"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("r"))).alias("b"))
    return _rounded(wide.agg(F.count("*").alias("n"), F.covar_pop("a", "b").alias("cov")), "cov", digits=8)


def _rates(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("vehicle"))
    rows = _residuals(spark, sf_dir).join(part, "l_partkey").withColumn("holder", F.col("l_suppkey"))
    train, test = F.col("split") == "train", F.col("split") == "test"
    return (
        rows.groupBy("vehicle", "holder")
        .agg(F.count_if(train).alias("n_train"), F.count_if(test).alias("n_test"), F.avg(F.when(train, F.col("y"))).alias("train_rate"), F.avg(F.when(test, F.col("y"))).alias("test_rate"))
        .where("n_train >= 3 and n_test >= 3")
    )


def holder_rate_table(spark, sf_dir):
    return _rounded(_rates(spark, sf_dir), "train_rate", "test_rate")


def holder_gaps(spark, sf_dir):
    return _rounded(V.holder_gaps(_rates(spark, sf_dir), ["vehicle"]), "oracle_gap", "train_gap", "recovered_gap")


def within_vehicle_spearman(spark, sf_dir):
    return _rounded(spearman_by(_rates(spark, sf_dir), ["vehicle"], "train_rate", "test_rate"), "spearman")


def signal_on_test(spark, sf_dir):
    """AUC on later rows of the forecast alone and with suppliers' shrunken earlier residuals added."""
    rows = _residuals(spark, sf_dir)
    past = rows.where("split = 'train'").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg("r").alias("m"))
    test = rows.where("split = 'test'").join(past, "l_suppkey").withColumn("q", F.round(F.col("p") + F.col("n") * F.col("m") / (F.col("n") + 20), 9)).withColumn("g", F.lit("all"))
    plain = auc_by(test, ["g"], "y", "p").select(F.lit("model").alias("forecast"), "n_pos", "n_neg", "auc")
    return _rounded(plain.unionByName(auc_by(test, ["g"], "y", "q").select(F.lit("with history").alias("forecast"), "n_pos", "n_neg", "auc")), "auc")


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("block"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("segment"))


def permute_within_block(spark, sf_dir):
    rows = B.permute_within(_customers(spark, sf_dir), ["block"], "id", "x", 3)
    return rows.select("draw", "block", "id", "shuffled")


def permutation_null(spark, sf_dir):
    """Correlation of balance and order total against 200 shuffles within nations: (b + 1) / (B + 1)."""
    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double").alias("t"))
    rows = _customers(spark, sf_dir).join(totals, "id")
    real = rows.agg(correlation("x", "t").alias("real"))
    drawn = B.permute_within(rows, ["block"], "id", "x", 200, give=["t"]).groupBy("draw").agg(correlation("shuffled", "t").alias("c"))
    value = real.first()[0]
    out = drawn.agg(F.count("*").alias("draws"), F.avg("c").alias("null_mean"), F.count_if(F.abs(F.round("c", 9)) >= F.lit(abs(round(value or 0.0, 9)))).alias("b"))
    return out.select(F.lit(round(value or 0.0, 6)).alias("real"), "draws", F.round("null_mean", 6).alias("null_mean"), F.round((F.col("b") + 1) / (F.col("draws") + 1), 6).alias("p_value"))


def bootstrap_rows(spark, sf_dir):
    """Weighted mean balance of every draw, rows drawn by Poisson weights."""
    rows = B.bootstrap(_customers(spark, sf_dir), "id", 20)
    return rows.groupBy("draw").agg(F.sum("weight").alias("total_weight"), F.round(F.sum(F.col("weight") * F.col("x")) / F.sum("weight"), 5).alias("mean"))


def bootstrap_clusters(spark, sf_dir):
    rows = B.bootstrap(_customers(spark, sf_dir), "block", 20)
    return rows.groupBy("draw").agg(F.sum("weight").alias("total_weight"), F.round(F.try_divide(F.sum(F.col("weight") * F.col("x")), F.sum("weight").cast("double")), 5).alias("mean"))


def stratified_sample(spark, sf_dir):
    return B.stratified_sample(_customers(spark, sf_dir), "segment", "id", 200).select("id", "segment")


def icc_null(spark, sf_dir):
    """ICC of balances by market segment against shuffles within nations."""
    rows = _customers(spark, sf_dir)
    drawn = B.permute_within(rows, ["block"], "id", "segment", 10, give=["x"])
    return _rounded(V.intraclass(V.group_moments(drawn, ["draw"], "shuffled", "x", 3)).select("draw", "k", "n", "icc"), "icc", digits=5)


def fixed_effects_r2(spark, sf_dir):
    """Share of order totals' variance that customers' nations and priorities explain together."""
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = table(spark, sf_dir, "orders").join(nation, "o_custkey").select("c_nationkey", "o_orderpriority", "o_totalprice")
    state = V.two_way_demeaned(rows, "c_nationkey", "o_orderpriority", "o_totalprice")
    return state.agg(F.count("*").alias("n"), F.round(1 - F.var_pop("residual") / F.var_pop("o_totalprice"), 6).alias("r2"))


QUERIES = {
    f.__name__: f
    for f in (
        snapshot_forward, snapshot_absence, previous_rating, persistence_forecast, rating_crosstab, exit_buckets, coverage_table, offset_gaps, first_observed,
        conflict_dedupe, anova_components, icc, cross_period_cov, split_half, holder_rate_table, holder_gaps, within_vehicle_spearman, signal_on_test,
        permute_within_block, permutation_null, bootstrap_rows, bootstrap_clusters, stratified_sample, icc_null, fixed_effects_r2,
    )
}

_PN = """pn as (select user_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) as int) as idx, sum(cast(value as decimal(20,6))) as total, max_by(event_type, {'a': ts, 'b': event_id}) as rating, count(*) as n_events,
  user_id % 7 as body from events group by user_id, 2)"""
_AB = (
    _PN
    + """, ab as (select p.*, case when exists (select 1 from pn c where c.body = p.body and c.idx = p.idx + 1) then not exists (select 1 from pn c where c.user_id = p.user_id and c.idx = p.idx + 1) end as absent_next,
    case when max(idx) over (partition by body) > idx then max(idx) over (partition by user_id) = idx end as exits from pn p)"""
)
_R = "r as (select *, cast(l_returnflag = 'R' as double) as y, l_discount * 10 as p, cast(l_returnflag = 'R' as double) - l_discount * 10 as r, case when l_shipdate < '1999-01-01' then 'train' else 'test' end as split from lineitem)"


def _moments(rows, by, group, value, least=1):
    return f"""c as (select {by}, {group} as g, count(*) as n, avg({value}) as m, var_pop({value}) as v from {rows} where {value} is not null and {group} is not null group by {by}, {group} having count(*) >= {least}),
      m as (select {by}, count(*) as k, cast(sum(n) as bigint) as n, (sum(n * m * m) - sum(n) * (sum(n * m) / sum(n)) * (sum(n * m) / sum(n))) / (count(*) - 1) as msb, sum(n * v) / (sum(n) - count(*)) as msw,
        (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) as n0 from c group by {by})"""


_RT = (
    _R
    + """, rt as (select p_brand as vehicle, l_suppkey as holder, count(*) filter (split = 'train') as n_train, count(*) filter (split = 'test') as n_test, avg(y) filter (split = 'train') as train_rate, avg(y) filter (split = 'test') as test_rate
    from r join part on p_partkey = l_partkey group by 1, 2 having count(*) filter (split = 'train') >= 3 and count(*) filter (split = 'test') >= 3)"""
)
_LIMITS = []
_t, _s = 2.718281828459045**-1, 0.0
for _k in range(1, 9):
    _s += _t
    _LIMITS.append(round(_s, 12))
    _t /= _k


def _poisson(ident):
    u = f"(cast(('0x' || substr(md5(cast({ident} as varchar) || '#' || cast(draw as varchar)), 1, 8)) as bigint) / 4294967296.0)"
    return "case " + " ".join(f"when cast({u} as double) < {v} then {k}" for k, v in enumerate(_LIMITS)) + " else 8 end"


def _boot(ident):
    return f"""with d as (select c.*, cast(unnest(range(20)) as int) as draw from customer c), w as (select draw, c_acctbal as x, {_poisson(ident)} as w from d)
      select draw, cast(sum(w) as bigint) as total_weight, round(sum(w * x) / nullif(sum(w), 0), 5) as mean from w group by 1"""


def _permuted(draws, value="c_acctbal"):
    return f"""d as (select c_custkey as id, c_nationkey as block, {value} as v, cast(unnest(range({draws})) as int) as draw from customer),
      a as (select *, row_number() over (partition by draw, block order by md5(cast(id as varchar) || '#-1'), id) as k from d), b as (select draw, block, v as shuffled, row_number() over (partition by draw, block order by md5(cast(id as varchar) || '#' || cast(draw as varchar)), id) as k from d),
      s as (select a.draw, a.block, a.id, b.shuffled from a join b using (draw, block, k))"""


SQL = {
    "snapshot_forward": f"""with {_PN} select p.user_id, p.idx, a.user_id is not null as present_1, b.user_id is not null as present_2, round(cast(a.total as double) / nullif(cast(p.total as double), 0) - 1, 6) as growth_1, a.rating <> p.rating as rating_changed
      from pn p left join pn a on a.user_id = p.user_id and a.idx = p.idx + 1 left join pn b on b.user_id = p.user_id and b.idx = p.idx + 2""",
    "snapshot_absence": f"with {_AB} select idx, count(*) as n, count(*) filter (absent_next) as n_absent_next, count(*) filter (absent_next is null) as n_unknown, count(*) filter (exits) as n_exits from ab group by 1",
    "previous_rating": f"with {_PN} select b.rating as before, p.rating as now, count(*) as n from pn p left join pn b on b.user_id = p.user_id and b.idx = p.idx - 1 group by 1, 2",
    "persistence_forecast": f"with {_PN} select p.idx, count(*) as n, round(avg(cast(p.rating = b.rating as double)), 6) as hit_rate from pn p join pn b on b.user_id = p.user_id and b.idx = p.idx - 1 group by 1",
    "rating_crosstab": f"with {_PN} select b.body, k.rating, (select count(*) from pn p where p.body = b.body and p.rating = k.rating) as n from (select distinct body from pn) b, (select distinct event_type as rating from events) k",
    "exit_buckets": f"""with {_AB} select case when not exits then 'stays' when idx >= 28 then 'last days' when idx >= 21 then 'last week' else 'earlier' end as bucket, count(*) as n, round(median(cast(total as double)), 6) as median_total from ab where exits is not null group by 1""",
    "coverage_table": f"with {_PN} select idx, count(*) as n_users, count_if(n_events > 1) as n_several, count(distinct body) as n_bodies, count(distinct rating) as n_ratings from pn group by 1",
    "offset_gaps": f"with {_PN}, g as (select idx - lag(idx) over (partition by user_id order by idx) as gap from pn) select gap, count(*) as n from g where gap is not null group by 1",
    "first_observed": f"with {_PN} select user_id, cast(min_by(total, idx) as double) as first_total, cast(max_by(total, idx) as double) as last_total, count(*) as n from pn group by 1",
    "conflict_dedupe": """with s as (select l_orderkey, l_linenumber, cast(l_partkey as varchar) || '|' || cast(l_suppkey as varchar) as sig, count(*) as n from lineitem group by 1, 2, 3),
      v as (select n, case when count(*) over (partition by l_orderkey, l_linenumber) > 1 then row_number() over (partition by l_orderkey, l_linenumber order by sig) else 0 end as variant from s) select cast(variant as int) as variant, count(*) as n, cast(sum(n) as bigint) as n_rows from v group by 1""",
    "anova_components": f"with {_R}, {_moments('r', 'split', 'l_suppkey', 'r')}, t as (select *, greatest(0, (msb - msw) / n0) as b from m) select split, k, n, round(msb, 6) as msb, round(msw, 6) as msw, round(n0, 6) as n0, round(b, 6) as between, round(b / (b + msw), 6) as share from t",
    "icc": f"with {_R}, {_moments('r', 'split', 'l_suppkey', 'y', 3)} select split, k, n, round((msb - msw) / (msb + (n0 - 1) * msw), 6) + 0.0 as icc from m",
    "cross_period_cov": f"with {_R}, w as (select l_suppkey, avg(r) filter (split = 'train') as a, avg(r) filter (split = 'test') as b from r group by 1) select count(*) as n, round(covar_pop(a, b), 8) as cov, round(corr(a, b), 8) as corr from w where a is not null and b is not null",
    "split_half": f"""with {_R}, h as (select *, cast(('0x' || substr(md5(cast(l_orderkey as varchar) || '/' || cast(l_linenumber as varchar) || '/' || cast(l_partkey as varchar) || '/' || strftime(l_shipdate, '%Y-%m-%d') || '#0'), 1, 1)) as int) % 2 as half from r),
      w as (select l_suppkey, avg(r) filter (half = 0) as a, avg(r) filter (half = 1) as b from h group by 1) select count(*) as n, round(covar_pop(a, b), 8) as cov from w""",
    "holder_rate_table": f"with {_RT} select vehicle, holder, n_train, n_test, round(train_rate, 6) as train_rate, round(test_rate, 6) as test_rate from rt",
    "holder_gaps": f"""with {_RT} select vehicle, count(*) as n_holders, round(max(test_rate) - min(test_rate), 6) as oracle_gap, round(max(train_rate) - min(train_rate), 6) as train_gap,
      round(max_by(test_rate, {{'a': train_rate, 'b': holder}}) - min_by(test_rate, {{'a': train_rate, 'b': holder}}), 6) as recovered_gap from rt group by 1 having count(*) >= 2""",
    "within_vehicle_spearman": f"""with {_RT}, k as (select vehicle, rank() over (partition by vehicle order by train_rate) + (count(*) over (partition by vehicle, train_rate) - 1) / 2.0 as a, rank() over (partition by vehicle order by test_rate) + (count(*) over (partition by vehicle, test_rate) - 1) / 2.0 as b from rt)
      select vehicle, count(*) as n, case when count(*) >= 3 and stddev_pop(cast(a as double)) > 0 and stddev_pop(cast(b as double)) > 0 then round(corr(cast(a as double), cast(b as double)), 6) end as spearman from k group by 1""",
    "signal_on_test": f"""with {_R}, h as (select l_suppkey, count(*) as n, avg(r) as m from r where split = 'train' group by 1), t as (select y, p, round(p + n * m / (n + 20), 9) as q from r join h using (l_suppkey) where split = 'test'),
      f as (select 'model' as forecast, y, p as s from t union all select 'with history', y, q from t), g as (select forecast, y, rank() over (partition by forecast order by s) + (count(*) over (partition by forecast, s) - 1) / 2.0 as k from f)
      select forecast, sum(y) as n_pos, sum(1 - y) as n_neg, round(cast(sum(k) filter (y = 1) as double) / (sum(y) * sum(1 - y)) - (sum(y) + 1) / (2 * sum(1 - y)), 6) as auc from g group by 1""",
    "permute_within_block": f"with {_permuted(3)} select draw, block, id, shuffled from s",
    "permutation_null": f"""with {_permuted(200)}, t as (select o_custkey as id, cast(sum(cast(o_totalprice as decimal(20,2))) as double) as t from orders group by 1),
      dd as (select c_custkey as id, c_nationkey as block, c_acctbal as v, cast(unnest(range(200)) as int) as draw from customer where c_custkey in (select id from t)),
      aa as (select *, row_number() over (partition by draw, block order by md5(cast(id as varchar) || '#-1'), id) as k from dd), bb as (select draw, block, v as shuffled, row_number() over (partition by draw, block order by md5(cast(id as varchar) || '#' || cast(draw as varchar)), id) as k from dd),
      ss as (select aa.draw, aa.id, bb.shuffled from aa join bb using (draw, block, k)), c as (select draw, corr(shuffled, t) as c from ss join t using (id) group by 1), r as (select corr(c_acctbal, t) as real from customer join t on t.id = c_custkey)
      select round(real, 6) as real, count(*) as draws, round(avg(c), 6) as null_mean, round((count_if(abs(round(c, 9)) >= abs(round(real, 9))) + 1) / (count(*) + 1), 6) as p_value from c, r group by real""",
    "bootstrap_rows": _boot("c_custkey"),
    "bootstrap_clusters": _boot("c_nationkey"),
    "stratified_sample": """with c as (select c_mktsegment as segment, count(*) as n from customer group by 1), e as (select segment, 200.0 * n / sum(n) over () as x from c), f as (select segment, floor(x) as b, round(x - floor(x), 9) as rest from e),
      q as (select segment, b + cast(row_number() over (order by rest desc, segment) <= 200 - sum(b) over () as int) as quota from f), r as (select c_custkey as id, c_mktsegment as segment, row_number() over (partition by c_mktsegment order by md5(cast(c_custkey as varchar) || '#0'), c_custkey) as k from customer)
      select id, segment from r join q using (segment) where k <= quota""",
    "icc_null": f"with {_permuted(10, 'c_mktsegment')}, x as (select s.draw, s.shuffled, c_acctbal as x from s join customer on c_custkey = s.id), {_moments('x', 'draw', 'shuffled', 'x', 3)} select draw, k, n, round((msb - msw) / (msb + (n0 - 1) * msw), 5) + 0.0 as icc from m",
}
