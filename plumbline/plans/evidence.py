"""Queries of matches, agreements, implied chances, conditional nulls and picks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import parsing as X
from ..functions.values import rating, squeezed_name
from ..operators import ledger as L
from ..operators import models as M
from ..operators import resample as B
from ..operators import scoring as S
from ..operators import tenders as T
from ..operators import variance as V
from ..operators.ranks import exact_quantiles
from ..operators.records import match_by_id_then_name
from ..session import table
from .ledger import _BASE
from .tenders import _TENDERS


def competed_awards(spark, sf_dir):
    """Base rows by competition code, with how many were competed."""
    base = L.base_rows(L.load_actions(table(spark, sf_dir, "action_ledger")))
    competed = E.is_competed(F.col("extent_competed_code"), F.col("number_of_offers_received"))
    return base.groupBy("extent_competed_code").agg(F.count("*").alias("n"), F.count_if(competed).alias("n_competed"))


def implied_chances(spark, sf_dir):
    """The chance of trouble that ratings imply, by snapshot and scale."""
    scale = E.scale_for_year(F.col("report_year"))
    p = E.implied_adverse(rating(F.col("dca_ipa")), scale)
    rows = table(spark, sf_dir, "panel_duplicates").select("snapshot_date", scale.alias("scale"), p.alias("p"))
    return rows.groupBy("snapshot_date", "scale").agg(F.count("*").alias("n"), F.count("p").alias("n_rated"), F.round(F.avg("p"), 6).alias("mean_adverse"))


def category_forms(spark, sf_dir):
    rows = table(spark, sf_dir, "panel_duplicates")
    return rows.groupBy(E.canonical_category(F.col("annual_report_category")).alias("category")).agg(F.count("*").alias("n"), F.count_distinct("annual_report_category").alias("n_forms"))


def header_positions(spark, sf_dir):
    """Positions that money headers with a financial year point to, by publication."""
    rows = spark.sql("select publication_slug, t.key as header from {r}, lateral variant_explode(try_parse_json(record)) t where t.key is not null", r=table(spark, sf_dir, "publication_rows").select("publication_slug", "record"))
    per = rows.groupBy("publication_slug").agg(F.sort_array(F.collect_set("header")).alias("headers"))
    return per.select("publication_slug", F.size("headers").alias("n_headers"), X.snapshot_of_headers(F.col("headers")).alias("position"))


def draft_crosscheck(spark, sf_dir):
    """Final rows of a snapshot against its drafts: by identifier, else by a name that is the only one, and how often ratings agree."""
    rows = table(spark, sf_dir, "panel_duplicates").select("row_id", "snapshot_date", "source_kind", "portfolio_id", F.nullif(squeezed_name(F.col("project_name")), F.lit("")).alias("name"), rating(F.col("dca_ipa")).alias("rag"))
    out = match_by_id_then_name(rows.where("source_kind = 'final'"), rows.where("source_kind = 'draft'"), ["snapshot_date"], "portfolio_id", "name", ["row_id", "rag"])
    return out.groupBy("snapshot_date", F.coalesce("matched_by", F.lit("none")).alias("matched_by")).agg(F.count("*").alias("n"), F.count_if(F.col("rag") == F.col("right_rag")).alias("n_agree"))


def end_date_agreement(spark, sf_dir):
    """How often the tender's copy and the registry agree on a contract's end."""
    lots = T.lot_outcomes(T.tender_rows(table(spark, sf_dir, "tender_records"))).where("days_extended is not null").withColumn("all", F.lit(1))
    later, same, extended = F.col("days_extended") > 0.5, F.abs("days_extended") < 0.5, F.col("duration_extension") == 1
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    median = exact_quantiles(lots.where(later), ["all"], "days_extended", [0.5], "q")
    found = lots.agg(
        F.count("*").alias("n"), share(same).alias("share_identical"), share(later).alias("share_later"), share(F.col("days_extended") < -0.5).alias("share_earlier"),
        share(F.when(extended, same)).alias("identical_if_extended"), share(F.when(F.coalesce(~extended, F.lit(True)), ~same)).alias("moved_if_not_extended"), share(F.when(~same, F.col("duration_extension"))).alias("extended_if_moved"),
    )
    return found.withColumn("all", F.lit(1)).join(median, "all", "left").select("*", F.round(F.col("q")[0], 6).alias("median_days_later")).drop("all", "q")


def linkage_table(spark, sf_dir):
    """Projects per snapshot, those that come again in the next one, and by which key they are told."""
    rows = table(spark, sf_dir, "panel_duplicates").where("snapshot_date is not null")
    name = F.nullif(squeezed_name(F.col("project_name")), F.lit(""))
    keyed = rows.select("snapshot_date", F.coalesce(F.concat(F.lit("id "), "portfolio_id"), F.concat(F.lit("name "), name)).alias("k"), F.col("portfolio_id").isNotNull().alias("by_id")).where("k is not null").distinct()
    # one row per snapshot
    following = rows.select("snapshot_date").distinct().withColumn("next", F.lead("snapshot_date").over(Window.orderBy("snapshot_date")))
    again = keyed.select(F.col("snapshot_date").alias("next"), "k", F.lit(True).alias("again"))
    linked = keyed.join(following, "snapshot_date").join(again, ["next", "k"], "left")
    last = F.max("next").isNull()
    n_linked = F.count_if("again")
    return linked.groupBy("snapshot_date").agg(
        F.count("*").alias("n_projects"), F.when(~last, n_linked).alias("n_linked"), F.when(~last, F.round(n_linked / F.count("*"), 6)).alias("link_rate"), F.count_if("by_id").alias("n_by_id"), F.count_if(~F.col("by_id")).alias("n_by_name")
    )


def heavy_awards(spark, sf_dir):
    """Twenty awards of eight actions or more: up to twelve with a ceiling that moved, a year of full values and an event; then
    with a moved ceiling and an event, with an event, and any; those of most actions first."""
    rows = L.load_actions(table(spark, sf_dir, "action_ledger"))
    base = L.base_rows(rows).select(L.KEY, "base_fy")
    full = rows.join(base, L.KEY).groupBy("base_fy").agg((F.count("*") == F.count("potential_total_value_of_award")).alias("full_year"))
    moved = F.abs(F.coalesce(F.sum(F.when(~F.col("is_base_mod"), F.col("base_and_all_options_value").cast("decimal(20,2)"))), F.lit(0))) > 1
    event = F.bool_or(F.coalesce(F.col("action_type_code").isin("A", "D", "E", "F", "X", "G"), F.lit(False)))
    per = rows.groupBy(L.KEY).agg(F.count("*").alias("n_actions"), moved.alias("moved"), event.alias("event")).where("n_actions >= 8")
    told = per.join(base, L.KEY).join(full, "base_fy")
    best = told.where("moved and event and full_year").orderBy(F.desc("n_actions"), L.KEY).limit(12).select(L.KEY, F.lit(0).alias("first"))
    tier = F.coalesce("first", F.when(F.col("moved") & F.col("event"), 1).when(F.col("event"), 2).otherwise(3))
    ranked = told.join(best, L.KEY, "left").withColumn("tier", tier)
    return ranked.orderBy("tier", F.desc("n_actions"), L.KEY).limit(20).select(L.KEY, "n_actions", "moved", "event", "tier")


def largest_files(spark, sf_dir):
    """Per body the file with most rows, the least name at a tie."""
    body = table(spark, sf_dir, "table_calendar_validation").where("publishing_body is not null").select("publication_slug", "publishing_body").distinct()
    sizes = table(spark, sf_dir, "publication_rows").groupBy("publication_slug").agg(F.count("*").alias("n"))
    order = F.struct(-F.col("n"), F.col("publication_slug"))
    return sizes.join(body, "publication_slug").groupBy("publishing_body").agg(F.min_by("publication_slug", order).alias("publication_slug"), F.max("n").alias("n_rows"), F.count("*").alias("n_files"))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("block"), F.col("c_acctbal").alias("x"), F.col("c_mktsegment").alias("segment"))


def conditional_icc(spark, sf_dir, draws=100):
    """ICC of balances by segment against shuffles of segments within nations: what nations can't account for."""
    rows = _customers(spark, sf_dir)
    observed = V.intraclass(V.group_moments(rows.withColumn("draw", F.lit(-1)), ["draw"], "segment", "x", 3)).select(F.col("icc").alias("observed"), F.col("n").alias("lots"), F.col("k").alias("groups"), F.lit(1).alias("one"))
    drawn = B.permute_within(rows, ["block"], "id", "segment", draws, give=["x"])
    null = V.intraclass(V.group_moments(drawn, ["draw"], "shuffled", "x", 3)).select("icc", F.lit(1).alias("one"))
    both = null.join(F.broadcast(observed), "one")
    return both.groupBy("lots", "groups", F.round("observed", 6).alias("icc")).agg(
        F.count("*").alias("draws"), F.round(F.avg("icc"), 6).alias("null_mean"), F.round(F.first("observed") - F.avg("icc"), 6).alias("excess"), F.round((F.count_if(F.round("icc", 9) >= F.round("observed", 9)) + 1) / (F.count("*") + 1), 6).alias("p_greater")
    )


def forward_isotonic(spark, sf_dir):
    """Forecasts' levels recalibrated on training rows and scored on test rows, per label, beside the training rate."""
    rows = S.known(table(spark, sf_dir, "predictions").distinct()).withColumn("level", F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int"))
    fitted = M.isotonic_levels(rows.where("split = 'train'"), ["label"], "level", "y")
    base = rows.where("split = 'train'").groupBy("label").agg(F.avg("y").alias("base"))
    # a level that training lacks takes the one below, else the least
    steps = fitted.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("level", "fitted"))).alias("steps"))
    below = F.filter("steps", lambda s: s["level"] <= F.col("level"))
    test = rows.where("split = 'test'").join(steps, "label").join(base, "label").withColumn("q", F.coalesce(F.try_element_at(below, F.lit(-1))["fitted"], F.get("steps", 0)["fitted"]))
    out = test.groupBy("label").agg(F.count("*").alias("n"), S.brier().alias("stated"), S.brier("y", "q").alias("isotonic"), F.avg(F.pow(F.col("base") - F.col("y"), F.lit(2))).alias("train_base"))
    return out.select("label", "n", F.round("stated", 6).alias("stated"), F.round("isotonic", 6).alias("isotonic"), F.round("train_base", 6).alias("train_base"), F.round(S.skill(F.col("isotonic"), F.col("train_base")), 6).alias("skill"))


def bootstrap_correlation(spark, sf_dir):
    """Correlation of nations' mean balances and customers' order counts, nations drawn anew fifty times, weighted by customers."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("n_orders"))
    groups = _customers(spark, sf_dir).join(orders, "id", "left").groupBy("block").agg(F.avg("x").alias("x"), F.avg(F.coalesce("n_orders", F.lit(0)).cast("double")).alias("t"), F.count("*").cast("double").alias("w"))
    return B.bootstrap_correlation(groups, "block", "x", "t", 50, "w").select("draw", F.round("corr", 5).alias("corr"))


def masked_permutation(spark, sf_dir):
    """Segments dealt anew among customers with a positive balance only, within nations: rows whose segment moved."""
    rows = B.permute_masked(_customers(spark, sf_dir).select("block", "id", "segment", "x"), F.col("x") > 0, ["block"], "id", "segment", 5)
    return rows.groupBy("draw", "segment").agg(F.count("*").alias("n"), F.count_if(F.col("segment") != F.col("shuffled")).alias("n_moved"))


QUERIES = {
    f.__name__: f
    for f in (
        competed_awards, implied_chances, category_forms, header_positions, draft_crosscheck, end_date_agreement, linkage_table, heavy_awards, largest_files, conditional_icc, forward_isotonic, bootstrap_correlation, masked_permutation,
    )
}

_SQ = "nullif(regexp_replace(lower(project_name), '[^\\p{L}\\p{N}]+', '', 'g'), '')"
_RAG = "case when lower(trim(regexp_replace(dca_ipa, '\\s+', ' ', 'g'))) in ('', '-', 'n/a', 'tbc', 'xxx', 'not provided', 'see previous return') then null else upper(replace(replace(replace(regexp_replace(lower(dca_ipa), '[^a-z]+', '', 'g'), 'green', 'g'), 'amber', 'a'), 'red', 'r')) end"
_P = "ok as (select distinct * from predictions where y is not null and p is not null)"
_ICC = """m as (select draw, count(*) as k, sum(n) as n, (sum(n * mm * mm) - sum(n * mm) * sum(n * mm) / sum(n)) / (count(*) - 1) as msb, sum(n * vv) / (sum(n) - count(*)) as msw, (sum(n) - sum(n * n) / sum(n)) / (count(*) - 1) as n0
    from (select draw, g, count(*) as n, avg(x) as mm, var_pop(x) as vv from d group by 1, 2 having count(*) >= 3) group by 1), i as (select *, (msb - msw) / (msb + (n0 - 1) * msw) as icc from m)"""


def _poisson(unit: str) -> str:
    u = f"cast('0x' || substr(md5(cast({unit} as varchar) || '#' || cast(draw as varchar)), 1, 8) as bigint) / 4294967296.0"
    limits, total, term = [], 0.0, 2.718281828459045**-1
    for k in range(1, 9):
        total += term
        limits.append(round(total, 12))
        term /= k
    return "case " + " ".join(f"when {u} < {v} then {k}" for k, v in enumerate(limits)) + " else 8 end"


SQL = {
    "implied_chances": f"""with r as (select snapshot_date, {_RAG} as rag, case when report_year between 2013 and 2021 then 'five' when report_year is not null then 'three' end as scale from panel_duplicates),
      q as (select *, case scale when 'five' then case rag when 'G' then 0.1 when 'AG' then 0.25 when 'A' then 0.5 when 'AR' then 0.75 when 'R' then 0.9 end when 'three' then case rag when 'G' then 0.15 when 'A' then 0.5 when 'R' then 0.85 end end as p from r)
      select snapshot_date, scale, count(*) as n, count(p) as n_rated, round(avg(p), 6) as mean_adverse from q group by 1, 2""",
    "competed_awards": f"with {_BASE} select extent_competed_code, count(*) as n, count(*) filter (extent_competed_code in ('A', 'D') and number_of_offers_received >= 2) as n_competed from base group by 1",
    "heavy_awards": f"""with {_BASE}, fy as (select base_fy, count(*) = count(tx.potential_total_value_of_award) as full_year from tx join base using (contract_award_unique_key) group by 1),
      p as (select contract_award_unique_key as k, count(*) as n_actions, abs(coalesce(sum(cast(base_and_all_options_value as decimal(20,2))) filter (not is_base_mod), 0)) > 1 as moved, bool_or(coalesce(action_type_code in ('A', 'D', 'E', 'F', 'X', 'G'), false)) as event from tx group by 1 having count(*) >= 8),
      t as (select p.*, full_year from p join base on base.contract_award_unique_key = p.k join fy on fy.base_fy = base.base_fy), b as (select k from t where moved and event and full_year order by n_actions desc, k limit 12)
      select k as contract_award_unique_key, n_actions, moved, event, cast(case when k in (select k from b) then 0 when moved and event then 1 when event then 2 else 3 end as int) as tier from t order by tier, n_actions desc, k limit 20""",
    "category_forms": """with r as (select annual_report_category as a, lower(trim(regexp_replace(annual_report_category, '\\s+', ' ', 'g'))) as k from panel_duplicates)
      select case when k in ('', 'nan', 'none') then null when k in ('ict', 'information and communications technology (ict)') then 'ICT' when k = 'government transformation and service delivery' then 'Government Transformation and Service Delivery'
        when k = 'infrastructure and construction' then 'Infrastructure and Construction' when k = 'military capability' then 'Military Capability' else trim(a) end as category, count(*) as n, count(distinct a) as n_forms from r group by 1""",
    "header_positions": """with k as (select distinct publication_slug, unnest(json_keys(try_cast(record as json))) as h from publication_rows where json_type(try_cast(record as json)) = 'OBJECT'), q as (select *, try_cast(regexp_extract(h, '\\b(20\\d\\d)\\s*[/-]\\s*\\d{2,4}\\b', 1) as int) as y,
        regexp_matches(lower(h), 'budget|forecast|baseline|variance') and not regexp_matches(lower(h), 'narrative|commentary|comment|explanation|real price|real term|price base') as money from k)
      select publication_slug, cast(count(*) as int) as n_headers, make_date(arg_min(y, h) filter (money and y between 2011 and 2030), 9, 30) as position from q group by 1""",
    "draft_crosscheck": f"""with r as (select row_id, snapshot_date, source_kind, portfolio_id, {_SQ} as name, {_RAG} as rag from panel_duplicates), f as (select * from r where source_kind = 'final'), d as (select * from r where source_kind = 'draft'),
      i as (select snapshot_date, portfolio_id, arg_min(coalesce(rag, ''), row_id) as rag from d where portfolio_id is not null group by 1, 2), n as (select snapshot_date, name, max(coalesce(rag, '')) as rag from d where name is not null group by 1, 2 having count(*) = 1)
      select f.snapshot_date, case when i.rag is not null then 'id' when n.rag is not null then 'name' else 'none' end as matched_by, count(*) as n, count(*) filter (f.rag = coalesce(i.rag, n.rag)) as n_agree
      from f left join i on i.snapshot_date = f.snapshot_date and i.portfolio_id = f.portfolio_id left join n on n.snapshot_date = f.snapshot_date and n.name = f.name group by 1, 2""",
    "end_date_agreement": f"""with {_TENDERS}, e as (select ext, case when reg_status is not null then cast(n_duration_extension > 0 as int) end as dx from lo where ext is not null)
      select count(*) as n, round(avg(cast(abs(ext) < 0.5 as double)), 6) as share_identical, round(avg(cast(ext > 0.5 as double)), 6) as share_later, round(avg(cast(ext < -0.5 as double)), 6) as share_earlier, round(avg(cast(abs(ext) < 0.5 as double)) filter (dx = 1), 6) as identical_if_extended,
      round(avg(cast(abs(ext) >= 0.5 as double)) filter (coalesce(dx <> 1, true)), 6) as moved_if_not_extended, round(avg(dx) filter (abs(ext) >= 0.5), 6) as extended_if_moved, round(median(ext) filter (ext > 0.5), 6) as median_days_later from e""",
    "linkage_table": f"""with r as (select distinct snapshot_date as s, coalesce('id ' || portfolio_id, 'name ' || {_SQ}) as k, portfolio_id is not null as by_id from panel_duplicates where snapshot_date is not null), d as (select s, lead(s) over (order by s) as nx from (select distinct snapshot_date as s from panel_duplicates where snapshot_date is not null)),
      j as (select r.*, nx, b.k is not null as again from r join d using (s) left join (select distinct s, k from r) b on b.s = d.nx and b.k = r.k where r.k is not null)
      select s as snapshot_date, count(*) as n_projects, case when max(nx) is not null then count(*) filter (again) end as n_linked, case when max(nx) is not null then round(count(*) filter (again) / count(*), 6) end as link_rate, count(*) filter (by_id) as n_by_id, count(*) filter (not by_id) as n_by_name from j group by 1""",
    "largest_files": """with s as (select publication_slug, count(*) as n from publication_rows group by 1), b as (select distinct publication_slug, publishing_body from table_calendar_validation where publishing_body is not null), j as (select * from s join b using (publication_slug))
      select publishing_body, (array_agg(publication_slug order by n desc, publication_slug))[1] as publication_slug, max(n) as n_rows, count(*) as n_files from j group by 1""",
    "conditional_icc": f"""with c as (select c_custkey as id, c_nationkey as block, c_acctbal as x, c_mktsegment as g from customer), e as (select *, cast(unnest(range(100)) as int) as draw from c),
      a as (select draw, block, id, x, row_number() over (partition by draw, block order by md5(cast(id as varchar) || '#-1'), id) as k from e), b as (select draw, block, g, row_number() over (partition by draw, block order by md5(cast(id as varchar) || '#' || cast(draw as varchar)), id) as k from e),
      d as (select draw, x, b.g from a join b using (draw, block, k) union all select -1, x, g from c), {_ICC}
      select (select n from i where draw = -1) as lots, (select k from i where draw = -1) as groups, round((select icc from i where draw = -1), 6) as icc, count(*) as draws, round(avg(icc), 6) as null_mean, round((select icc from i where draw = -1) - avg(icc), 6) as excess,
      round((count(*) filter (round(icc, 9) >= round((select icc from i where draw = -1), 9)) + 1) / (count(*) + 1), 6) as p_greater from i where draw >= 0""",
    "forward_isotonic": f"""with {_P}, r as (select *, least(cast(floor(p * 10) as int), 9) as level from ok), c as (select label, level, count(*) as n, sum(y) as s from r where split = 'train' group by 1, 2),
      w as (select a.label, a.level as i, b.level as k, sum(m.s) / sum(m.n) as mean from c a join c b on a.label = b.label and a.level <= b.level join c m on m.label = a.label and m.level between a.level and b.level group by 1, 2, 3),
      f as (select label, level, max(low) as q from (select c.label, c.level, w.i, min(w.mean) as low from c join w on w.label = c.label and w.i <= c.level and w.k >= c.level group by 1, 2, 3) group by 1, 2), b as (select label, avg(y) as base from r where split = 'train' group by 1),
      t as (select r.label, r.y, r.p, base, coalesce((select arg_max(q, f.level) from f where f.label = r.label and f.level <= r.level), (select arg_min(q, f.level) from f where f.label = r.label)) as q from r join b using (label) where split = 'test')
      select label, count(*) as n, round(avg((p - y) * (p - y)), 6) as stated, round(avg((q - y) * (q - y)), 6) as isotonic, round(avg((base - y) * (base - y)), 6) as train_base, round(1 - avg((q - y) * (q - y)) / avg((base - y) * (base - y)), 6) as skill from t group by 1""",
    "bootstrap_correlation": f"""with o as (select o_custkey as id, count(*) as n from orders group by 1), g as (select c_nationkey as block, avg(c_acctbal) as x, avg(coalesce(n, 0)) as t, count(*) as w from customer left join o on o.id = c_custkey group by 1), e as (select *, cast(unnest(range(50)) as int) as draw from g),
      u as (select draw, x, t, w * ({_poisson('block')}) as w from e), m as (select draw, sum(w * x) / sum(w) as mx, sum(w * t) / sum(w) as mt from u group by 1)
      select draw, round(sum(w * (x - mx) * (t - mt)) / nullif(sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (t - mt) * (t - mt))), 0), 5) as corr from u join m using (draw) group by 1""",
    "masked_permutation": """with c as (select c_custkey as id, c_nationkey as block, c_mktsegment as g, c_acctbal > 0 as m, cast(unnest(range(5)) as int) as draw from customer), a as (select *, row_number() over (partition by draw, block order by md5(cast(id as varchar) || '#-1'), id) as k from c where m),
      b as (select draw, block, g as h, row_number() over (partition by draw, block order by md5(cast(id as varchar) || '#' || cast(draw as varchar)), id) as k from c where m), u as (select draw, g, h from a join b using (draw, block, k) union all select draw, g, g from c where not m)
      select draw, g as segment, count(*) as n, count(*) filter (g <> h) as n_moved from u group by 1, 2""",
}
