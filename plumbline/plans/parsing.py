"""Queries of parsers, calendars and further nulls."""

from pyspark.sql import functions as F

from ..functions import exprs as E
from ..functions import parsing as X
from ..functions.values import plain_name, rating, squeezed_name
from ..operators import resample as B
from ..operators import scoring as S
from ..operators import windows as W
from ..operators.documents import latest_rating
from ..operators.drift import field_of, header_stem
from ..session import table
from .drift import _FIELD, _STEM


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


def money_kinds(spark, sf_dir):
    """Every row by the kind of its baseline cell, and the total of the figures as published: units are not converted
    (p7_found does that), and by the rule of money_kind a cell with words such as GBP, pounds or thousand is prose."""
    rows = _t(spark, sf_dir, "panel_duplicates")
    rows = rows.select(X.money_parts(F.col("wlc_baseline_gbp_m")).alias("m"))
    return rows.groupBy("m.kind").agg(F.count("*").alias("n"), F.sum(F.col("m.figure").cast("decimal(24,6)")).cast("double").alias("total"))


def rating_forms(spark, sf_dir):
    """Ratings after harmonising, with their rank in the scale of the report year."""
    r = rating(F.col("dca_ipa"))
    scale = E.scale_for_year(F.col("report_year"))
    return _t(spark, sf_dir, "panel_duplicates").groupBy(r.alias("rating"), scale.alias("scale")).agg(F.count("*").alias("n"), F.max(E.rank_in_scale(r, scale)).alias("rank"), F.max(E.normalised_rank(r, scale)).alias("normalised"))


def date_orders(spark, sf_dir):
    """Per file: votes of numeric dates for day or month first, and how many end dates of any writing can then be read."""
    day, month = X.order_votes(F.col("end_date"))
    rows = _t(spark, sf_dir, "panel_duplicates").select("publication_slug", "end_date")
    votes = rows.groupBy(F.col("publication_slug").alias("slug")).agg(F.count_if(day).alias("day_votes"), F.count_if(month).alias("month_votes"))
    joined = rows.join(votes, F.col("publication_slug").eqNullSafe(F.col("slug")))
    read = X.with_parsed_date(joined, "end_date", F.col("month_votes") > F.col("day_votes"), "d")
    return read.groupBy("publication_slug").agg(F.max("day_votes").alias("day_votes"), F.max("month_votes").alias("month_votes"), F.count("d").alias("n_read"), F.max("d").alias("latest"))


def name_forms(spark, sf_dir):
    """Distinct spellings per squeezed name: how many forms the commonest names have."""
    rows = _t(spark, sf_dir, "panel_duplicates").where("trim(project_name) <> ''")
    return rows.groupBy(squeezed_name(F.col("project_name")).alias("name")).agg(F.count_distinct("project_name").alias("n_forms"), F.count("*").alias("n")).orderBy(F.desc("n_forms"), F.desc("n"), "name").limit(25)


def header_profile(spark, sf_dir):
    """Calendar positions by how they are written, with the years they occur in."""
    kind = F.when(F.col("money_header_implies").rlike(r"^\d{5}$"), "serial").when(F.col("money_header_implies").rlike(r"(?i)^(fy)?\d{2,4}[-/]\d{2,4}$"), "financial year").when(F.col("money_header_implies").isNull(), "none").otherwise("date")
    return _t(spark, sf_dir, "table_calendar_validation").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("publication_year").cast("string"))), " ").alias("years"))


def calendar_verdicts(spark, sf_dir):
    """Verdicts by year, and whether the dated position agrees with one derived from the publication year."""
    rows = _t(spark, sf_dir, "table_calendar_validation")
    derived = X.snapshot_of(F.lit(None).cast("date"), F.lit(None).cast("date"), F.col("publication_year") - 1)
    return rows.groupBy("publication_year").agg(
        F.count("*").alias("n"), F.count_if(F.col("verdict") == "agrees").alias("n_agree"), F.count_if(F.col("verdict") == "disagrees").alias("n_disagree"), F.count_if(F.col("dated_snapshot") == derived).alias("n_by_year")
    )


def feed_instants(spark, sf_dir):
    """Modification instants of mixed spelling: rows by kind and local day's month, and the mean lag until fetched."""
    at = X.to_instant(F.col("date_modified"))
    rows = _t(spark, sf_dir, "tender_records").withColumn("at", at)
    return rows.groupBy("doc_kind", F.year(X.local_date(F.col("at"))).alias("year")).agg(F.count("*").alias("n"), F.countDistinct("object_id").alias("n_objects"))


def identifier_dates(spark, sf_dir):
    """Dates inside tender identifiers, straight from the text."""
    ident = F.regexp_extract("body", r'"tenderID":\s*"([^"]+)"', 1)
    rows = _t(spark, sf_dir, "tender_records").where("doc_kind = 'tender' and body is not null")
    return rows.groupBy(F.year(X.date_in_identifier(ident)).alias("year")).agg(F.count("*").alias("n"))


def newest_versions(spark, sf_dir):
    """Versions per object and the span between the first and the last."""
    at = X.to_instant(F.col("date_modified"))
    per = _t(spark, sf_dir, "tender_records").groupBy("doc_kind", "object_id").agg(F.count("*").alias("n"), F.floor((F.unix_seconds(F.max(at)) - F.unix_seconds(F.min(at))) / 86400).alias("days"))
    return per.groupBy("doc_kind", "n").agg(F.count("*").alias("n_objects"), F.max("days").alias("most_days"))


def four_point_scale(spark, sf_dir):
    """Attribute ratings of both vocabularies in four and six points."""
    rows = _t(spark, sf_dir, "project_attributes").where("lower(trim(column_name)) in ('isr_last_pdo_rating', 'ieg_outcome')")
    v = F.col("value_text")
    return rows.groupBy(F.lower(F.trim(v)).alias("value")).agg(F.count("*").alias("n"), F.max(X.four_point(v)).alias("four"), F.max(E.six_point(v)).alias("six"), F.max(X.risk_vintage(v)).alias("vintage"))


def header_fields(spark, sf_dir):
    """Cells per canonical field over all delivered files, null values left out."""
    rows = spark.sql("select t.key as header, schema_of_variant(t.value) as kind from {r}, lateral variant_explode(try_parse_json(record)) t", r=_t(spark, sf_dir, "publication_rows").select("record"))
    return rows.where("kind <> 'VOID'").groupBy(field_of(header_stem(F.col("header"))).alias("field")).agg(F.count("*").alias("n"), F.count_distinct("header").alias("n_headers"))


def sampled_days(spark, sf_dir):
    return W.day_windows(spark, "2024-01-01", "2025-01-01", 10).select("day", F.round((F.unix_seconds("to_instant") - F.unix_seconds("from_instant")) / 3600, 3).alias("hours"))


def tiled_months(spark, sf_dir):
    return W.month_windows(spark, "2023-03-15", "2024-03-01")


def adaptive_folds(spark, sf_dir):
    rows = latest_rating(_t(spark, sf_dir, "rated_projects")).withColumn("y", F.year("boardapprovaldate"))
    cut = W.adaptive_cut(rows, "y", 2005, 2010, 150)
    return spark.createDataFrame([(k, int(v)) for k, v in cut.items()], "name string, value int")


def breakdown_table(spark, sf_dir):
    """Forecast scores by agency and split where a cell has at least 20 rows."""
    rows = _t(spark, sf_dir, "predictions").distinct().withColumn("agency", E.agency_of_key(F.col("contract_award_unique_key")))
    out = S.metric_bundle(rows, ["agency", "split"]).where("n >= 20")
    return out.select("agency", "split", "n", F.round("base_rate", 6).alias("base_rate"), F.round("brier", 6).alias("brier"))


def sensitivity_grid(spark, sf_dir):
    """Brier and AUC over populations that differ by one rule each."""
    rows = S.known(_t(spark, sf_dir, "predictions").distinct())
    rules = [("all", F.lit(True)), ("with vehicle", F.col("vehicle").isNotNull()), ("test only", F.col("split") == "test"), ("from 2018", F.col("predicted_at") >= F.lit("2018-01-01")), ("36 months", F.col("horizon") == 36)]
    each = F.filter(F.array(*[F.struct(F.lit(n).alias("population"), c.alias("in")) for n, c in rules]), lambda x: x["in"])
    long = rows.select("label", "y", "p", F.inline(each))
    by = ["label", "population"]
    return S.metric_bundle(long, by).join(S.auc_by(long, by).select(*by, "auc"), by).select(*by, "n", F.round("brier", 6).alias("brier"), F.round("auc", 6).alias("auc"))


def calibration_by_rating(spark, sf_dir):
    """Observed rate against the forecast's own level, every level listed even when empty."""
    rows = S.known(_t(spark, sf_dir, "predictions").distinct())
    level = F.when(F.col("p") < 0.1, "G").when(F.col("p") < 0.2, "AG").when(F.col("p") < 0.35, "A").when(F.col("p") < 0.6, "AR").otherwise("R")
    found = rows.groupBy("horizon", level.alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("y"), 6).alias("observed"))
    grid = rows.select("horizon").distinct().select("horizon", F.explode(F.array(*map(F.lit, ("G", "AG", "A", "AR", "R")))).alias("level"))
    return grid.join(found, ["horizon", "level"], "left").na.fill(0, ["n"])


def placebo_auc(spark, sf_dir):
    """AUC of each of ten shuffles of outcomes within labels: centred on one half."""
    rows = S.known(_t(spark, sf_dir, "predictions").distinct())
    drawn = B.permute_within(rows.select("label", "prediction_id", "y"), ["label"], "prediction_id", "y", 10).join(rows.select("prediction_id", "p"), "prediction_id")
    return S.auc_by(drawn.withColumnRenamed("shuffled", "z"), ["label", "draw"], "z", "p").select("label", "draw", F.round("auc", 6).alias("auc"))


def identity_persistence(spark, sf_dir):
    """Agencies' rates in training and test rows, and their correlation per label."""
    rows = S.known(_t(spark, sf_dir, "predictions").distinct()).withColumn("agency", E.agency_of_key(F.col("contract_award_unique_key")))
    wide = rows.groupBy("label", "agency").agg(
        F.count_if(F.col("split") == "train").alias("a_n"), F.count_if(F.col("split") == "test").alias("b_n"),
        F.avg(F.when(F.col("split") == "train", F.col("y"))).alias("a"), F.avg(F.when(F.col("split") == "test", F.col("y"))).alias("b"),
    ).where("a_n >= 3 and b_n >= 3")
    return wide.groupBy("label").agg(F.count("*").alias("n"), F.round(S.correlation("a", "b"), 6).alias("corr"))


def word_overlap(spark, sf_dir):
    """Mean words per document and how many words names and departments share."""
    rows = _t(spark, sf_dir, "panel_duplicates").where("project_name is not null and department is not null")
    shared = F.size(F.array_intersect(F.split(plain_name(F.col("project_name")), " "), F.split(plain_name(F.col("department")), " ")))
    return rows.groupBy(shared.alias("n_shared")).agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        money_kinds, rating_forms, date_orders, name_forms, header_profile, calendar_verdicts, feed_instants, identifier_dates, newest_versions, four_point_scale,
        header_fields, sampled_days, tiled_months, adaptive_folds, breakdown_table, sensitivity_grid, calibration_by_rating, placebo_auc, identity_persistence,
        word_overlap,
    )
}

_P = "ok as (select distinct * from predictions where y is not null and p is not null)"
_AG = "nullif(regexp_extract(contract_award_unique_key, '_([^_]+)$', 1), '')"
_RATING = "case when lower(trim(regexp_replace({0}, '\\s+', ' ', 'g'))) in ('', '-', 'n/a', 'tbc', 'xxx', 'not provided', 'see previous return') then null else upper(replace(replace(replace(regexp_replace(lower({0}), '[^a-z]+', '', 'g'), 'green', 'g'), 'amber', 'a'), 'red', 'r')) end"
_AT = "cast(date_modified as timestamptz)"
SQL = {
    "money_kinds": """with r as (select trim(regexp_replace(replace(replace(wlc_baseline_gbp_m, chr(160), ' '), '−', '-'), '\\s+', ' ', 'g')) as t from panel_duplicates),
      k as (select t, case when regexp_matches(t, '(?i)\\b(exempt|sections?\\s+\\d|freedom of information|not (yet )?in a position|planning stage|commercial interests|national security|not applicable\\b|intended for future publication|formulation of government policy|international relations|law enforcement|defence\\b|no dca\\b|to be confirmed\\b|withheld|redacted|not yet agreed|not published|not disclosed|not provided|not available)') then 'withheld'
          when t is null or lower(t) in ('', '-', '--', '?', '.', 'n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'tbc', 'tbd', 'xxx', 'unknown', 'see previous return', 'as before', 'nan', '#n/a', 'not known') then 'missing'
          when regexp_matches(t, '(?i)(low|mid)\\s*[:=]\\s*-?\\d') then 'range'
          when regexp_matches(regexp_replace(t, '(?i)(\\d)\\s*(million|billion|mn|bn|m|k)\\.?$', '\\1'), '[^0-9 £$%.,()+<>~≤≥ÂœÿúâŒŸÚ-]') then 'prose' when regexp_matches(t, '\\d') then 'value' else 'missing' end as kind from r),
      v as (select kind, case when kind = 'value' then try_cast(replace(regexp_extract(t, '-?\\d[\\d,]*(\\.\\d+)?'), ',', '') as decimal(24,6)) * case when t like '(%)' then -1 else 1 end
          when kind = 'range' then try_cast(replace(regexp_extract(t, '(?i)mid\\s*[:=]\\s*(-?\\d[\\d,]*(\\.\\d+)?)', 1), ',', '') as decimal(24,6)) end as v from k)
      select kind, count(*) as n, cast(sum(v) as double) as total from v group by 1""",
    "rating_forms": f"""with r as (select {_RATING.format('dca_ipa')} as rating, case when report_year between 2013 and 2021 then 'five' when report_year is not null then 'three' end as scale from panel_duplicates),
      k as (select *, case when scale = 'five' then case rating when 'G' then 0 when 'AG' then 1 when 'A' then 2 when 'AR' then 3 when 'R' then 4 end when scale = 'three' then case rating when 'G' then 0 when 'A' then 1 when 'R' then 2 end end as rk from r)
      select rating, scale, count(*) as n, max(rk) as rank, max(rk / case when scale = 'five' then 4.0 else 2.0 end) as normalised from k group by 1, 2""",
    "date_orders": """with t as (select publication_slug, trim(end_date) as t from panel_duplicates), q as (select publication_slug, t, case when regexp_full_match(t, '\\d{1,2}[-./]\\d{1,2}[-./](\\d{4}|\\d{2})') then string_split(regexp_replace(t, '[-.]', '/', 'g'), '/') end as p from t),
      r as (select publication_slug, t, cast(p[1] as int) as a, cast(p[2] as int) as b, cast(p[3] as int) + case when length(p[3]) = 4 then 0 when cast(p[3] as int) < 70 then 2000 else 1900 end as y from q),
      v as (select publication_slug, count(*) filter (a > 12 and b <= 12) as d, count(*) filter (b > 12 and a <= 12) as m from r group by 1),
      p as (select r.publication_slug, d, m, case when a is null then cast(try_strptime(t, ['%Y-%m-%d', '%Y%m%d', '%d-%b-%y', '%d %B %Y', '%d %b %Y']) as date)
          when m > d then coalesce(try_cast(printf('%04d-%02d-%02d', y, a, b) as date), try_cast(printf('%04d-%02d-%02d', y, b, a) as date)) else coalesce(try_cast(printf('%04d-%02d-%02d', y, b, a) as date), try_cast(printf('%04d-%02d-%02d', y, a, b) as date)) end as dt
        from r join v on r.publication_slug is not distinct from v.publication_slug)
      select publication_slug, max(d) as day_votes, max(m) as month_votes, count(dt) filter (year(dt) between 1990 and 2099) as n_read, max(dt) filter (year(dt) between 1990 and 2099) as latest from p group by 1""",
    "name_forms": "select regexp_replace(lower(project_name), '[^\\p{L}\\p{N}]+', '', 'g') as name, count(distinct project_name) as n_forms, count(*) as n from panel_duplicates where trim(project_name, ' ') <> '' group by 1 order by n_forms desc, n desc, name limit 25",
    "header_profile": """select case when regexp_full_match(money_header_implies, '[0-9]{5}') then 'serial' when regexp_full_match(money_header_implies, '(?i)(fy)?[0-9]{2,4}[-/][0-9]{2,4}') then 'financial year' when money_header_implies is null then 'none' else 'date' end as kind, count(*) as n,
      array_to_string(list_sort(list_distinct(list(cast(publication_year as varchar)) filter (publication_year is not null))), ' ') as years from table_calendar_validation group by 1""",
    "calendar_verdicts": """select publication_year, count(*) as n, count(*) filter (verdict = 'agrees') as n_agree, count(*) filter (verdict = 'disagrees') as n_disagree,
      count(*) filter (dated_snapshot = case when publication_year - 1 <= 2018 then make_date(publication_year - 1, 9, 30) else make_date(publication_year - 1, 3, 31) end) as n_by_year from table_calendar_validation group by 1""",
    "newest_versions": f"with p as (select doc_kind, object_id, count(*) as n, cast(floor((epoch(date_trunc('second', max({_AT}))) - epoch(date_trunc('second', min({_AT})))) / 86400) as bigint) as days from tender_records group by 1, 2) select doc_kind, n, count(*) as n_objects, max(days) as most_days from p group by 1, 2",
    "identifier_dates": "select cast(year(try_cast(substr(regexp_extract(body, '\"tenderID\":\\s*\"([^\"]+)\"', 1), 4, 10) as date)) as int) as year, count(*) as n from tender_records where doc_kind = 'tender' and body is not null group by 1",
    "four_point_scale": f"""with r as (select value_text as v, lower(trim(value_text)) as t, replace(lower(trim(value_text)), '-', ' ') as u from project_attributes where lower(trim(column_name)) in ('isr_last_pdo_rating', 'ieg_outcome'))
      select t as value, count(*) as n, max(case u when 'negligible' then 1 when 'modest' then 2 when 'substantial' then 3 when 'high' then 4 when 'negligible to low' then 1 when 'moderate' then 2 when 'significant' then 3 end) as four,
      max(case t {' '.join(f"when '{n}' then {i}" for i, n in enumerate(E.SIX_POINTS, 1))} end) as six, max(case when u = 'high' then 'both' when u in ('negligible', 'modest', 'substantial') then 'new' when u in ('negligible to low', 'moderate', 'significant') then 'old' end) as vintage from r group by 1""",
    "tiled_months": "with m as (select cast(unnest(generate_series(date '2023-03-01', date '2024-02-29', interval 1 month)) as date) as month_start) select month_start, cast(month_start + interval 1 month as date) as month_end from m",
    "adaptive_folds": """with l as (select projectid, year(boardapprovaldate) as y from rated_projects where projectid is not null qualify row_number() over (partition by projectid order by coalesce(ieg_evaluation_fy, -1) desc, coalesce(ieg_outcome, '') desc, coalesce(log_commitment, -1) desc) = 1),
      v as (select max(e) as e from (select unnest(range(2006, 2011)) as e) c where e = 2006 or (select count(*) from l where y > e) >= 150)
      select 'train_end' as name, 2005 as value union all select 'valid_end', cast(e as int) from v union all select 'n_train', cast((select count(*) from l where y <= 2005) as int)
      union all select 'n_valid', cast((select count(*) from l where y > 2005 and y <= e) as int) from v union all select 'n_test', cast((select count(*) from l where y > e) as int) from v""",
    "breakdown_table": f"with {_P} select {_AG} as agency, split, count(*) as n, round(avg(y), 6) as base_rate, round(avg((p - y) * (p - y)), 6) as brier from ok group by 1, 2 having count(*) >= 20",
    "sensitivity_grid": f"""with {_P}, l as (select label, y, p, 'all' as population from ok union all select label, y, p, 'with vehicle' from ok where vehicle is not null union all select label, y, p, 'test only' from ok where split = 'test'
        union all select label, y, p, 'from 2018' from ok where predicted_at >= '2018-01-01' union all select label, y, p, '36 months' from ok where horizon = 36),
      k as (select *, rank() over (partition by label, population order by p) + (count(*) over (partition by label, population, p) - 1) / 2.0 as rk from l)
      select label, population, count(*) as n, round(avg((p - y) * (p - y)), 6) as brier, round((cast(sum(rk) filter (y = 1) as double) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * sum(1 - y), 0), 6) as auc from k group by 1, 2""",
    "calibration_by_rating": f"""with {_P}, r as (select horizon, y, case when p < 0.1 then 'G' when p < 0.2 then 'AG' when p < 0.35 then 'A' when p < 0.6 then 'AR' else 'R' end as level from ok), g as (select distinct horizon, unnest(['G', 'AG', 'A', 'AR', 'R']) as level from ok)
      select g.horizon, g.level, count(y) as n, round(avg(y), 6) as observed from g left join r using (horizon, level) group by 1, 2""",
    "placebo_auc": f"""with {_P}, d as (select label, prediction_id as id, y, p, cast(unnest(range(10)) as int) as draw from ok), a as (select *, row_number() over (partition by draw, label order by md5(cast(id as varchar) || '#-1'), id) as k from d),
      b as (select draw, label, y as z, row_number() over (partition by draw, label order by md5(cast(id as varchar) || '#' || cast(draw as varchar)), id) as k from d), s as (select a.draw, a.label, a.p, b.z from a join b using (draw, label, k)),
      r as (select *, rank() over (partition by draw, label order by p) + (count(*) over (partition by draw, label, p) - 1) / 2.0 as rk from s)
      select label, draw, round((cast(sum(rk) filter (z = 1) as double) - sum(z) * (sum(z) + 1) / 2) / nullif(sum(z) * sum(1 - z), 0), 6) as auc from r group by 1, 2""",
    "identity_persistence": f"""with {_P}, w as (select label, {_AG} as agency, avg(y) filter (split = 'train') as a, avg(y) filter (split = 'test') as b from ok group by 1, 2 having count(*) filter (split = 'train') >= 3 and count(*) filter (split = 'test') >= 3)
      select label, count(*) as n, round(corr(a, b), 6) as corr from w group by 1""",
    "word_overlap": """with r as (select string_split(trim(regexp_replace(lower(project_name), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') as a, string_split(trim(regexp_replace(lower(department), '[^\\p{L}\\p{N}]+', ' ', 'g')), ' ') as b from panel_duplicates where project_name is not null and department is not null)
      select cast(len(list_intersect(a, b)) as int) as n_shared, count(*) as n from r group by 1""",
    "feed_instants": f"select doc_kind, cast(year(timezone('Europe/Kyiv', try_cast(date_modified as timestamptz))) as int) as year, count(*) as n, count(distinct object_id) as n_objects from tender_records group by 1, 2",
    "sampled_days": """with d as (select cast(unnest(generate_series(date '2024-01-01', date '2024-12-31', interval 10 day)) as date) as day)
      select day, round((epoch(timezone('Europe/Kyiv', cast(day as timestamp) + interval 1 day)) - epoch(timezone('Europe/Kyiv', cast(day as timestamp)))) / 3600, 3) as hours from d""",
    "header_fields": f"""with k as (select unnest(json_keys(try_cast(record as json))) as key, try_cast(record as json) as j from publication_rows where json_type(try_cast(record as json)) = 'OBJECT'), e as (select key, json_type(j, '$."' || replace(key, '"', '\\"') || '"') as kind from k),
      s as (select key, {_STEM} as stem from e where kind <> 'NULL'), f as (select key, {_FIELD} as field from s) select field, count(*) as n, count(distinct key) as n_headers from f group by 1""",
}
