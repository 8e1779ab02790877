"""Problem 5: what changed between full snapshots."""

from pyspark.sql import functions as F

from ..functions.values import CUT_MARKS, FILLERS, PROGRAMME_WORDS, SHORT_FORMS
from ..operators.snapshots import project_changes
from ..session import table
from .quantities import NOTE_SQL, cell_sql


def p5_found(spark, sf_dir):
    return project_changes(table(spark, sf_dir, "panel_duplicates"))


def p5_counts(spark, sf_dir):
    """Changes by snapshot, kind and field."""
    found = project_changes(table(spark, sf_dir, "panel_duplicates"))
    return found.groupBy("snapshot_date", "change_kind", "field_name").agg(F.count("*").alias("n"))


QUERIES = {"p5_found": p5_found, "p5_counts": p5_counts}

_NO = ", ".join("'" + f.replace("'", "''") + "'" for f in FILLERS)


def _ok(c):
    return f"{c} is not null and lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))) not in ({_NO})"


_STEMS = "|".join(sorted({w[:i] for w in PROGRAMME_WORDS for i in range(1, len(w))} - set(SHORT_FORMS)))
_RATED = "upper(replace(replace(replace(regexp_replace(lower(dca_ipa), '[^a-z]+', '', 'g'), 'green', 'g'), 'amber', 'a'), 'red', 'r'))"
_DATED = "coalesce(cast(cast(try_strptime(trim(end_date), ['%Y-%m-%d', '%d.%m.%Y', '%d/%m/%Y', '%Y%m%d', '%d-%b-%y', '%d %B %Y']) as date) as varchar), trim(end_date))"
_PLAIN = "trim(regexp_replace(lower(project_name), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
_CHANGES = f"""r as (select *, row_number() over (order by case source_kind when 'final' then 0 when 'draft' then 1 else 2 end, published_at desc nulls last, row_id) as place, {_PLAIN} as plain,
    {cell_sql('wlc_baseline_gbp_m')[0]} as v, {cell_sql('wlc_baseline_gbp_m')[1]} as own, {NOTE_SQL} as note from panel_duplicates where portfolio_id is not null and snapshot_date is not null),
  n as (select distinct portfolio_id, plain from r where {_ok('project_name')}),
  cut as (select distinct a.portfolio_id, a.plain from n a join n b on a.portfolio_id = b.portfolio_id and starts_with(b.plain, a.plain) and regexp_matches(substr(b.plain, length(a.plain) + 1, 1), '\\p{{L}}') and regexp_matches(a.plain, '\\p{{L}}$')),
  m as (select r.portfolio_id, snapshot_date, place,
    case when {_ok('project_name')} and cut.plain is null and not regexp_matches(project_name, '(?i){CUT_MARKS}') and not regexp_matches(project_name, '(?i)[\\s_\\-]\\S+[\\s_\\-]({_STEMS})\\s*$') then regexp_replace(lower(project_name), '[^\\p{{L}}\\p{{N}}]+', '', 'g') end as project_name,
    case when {_ok('dca_ipa')} then {_RATED} end as dca_ipa, case when {_ok('end_date')} then {_DATED} end as end_date,
    cast(round(v * cast(coalesce(own, note, case when v >= 500000 then 1.0 else 1e6 end) as decimal(20,3)), 0) as bigint) as wlc_baseline_gbp_m from r left join cut on cut.portfolio_id = r.portfolio_id and cut.plain = r.plain),
  s as (select portfolio_id, snapshot_date, min_by(project_name, place) filter (project_name is not null) as project_name, min_by(dca_ipa, place) filter (dca_ipa is not null) as dca_ipa,
    min_by(wlc_baseline_gbp_m, place) filter (wlc_baseline_gbp_m is not null) as wlc_baseline_gbp_m, min_by(end_date, place) filter (end_date is not null) as end_date from m group by 1, 2),
  d as (select snapshot_date as now, lag(snapshot_date) over (order by snapshot_date) as before from (select distinct snapshot_date from s)),
  p as (select d.now, d.before, s.portfolio_id from d join (select distinct portfolio_id from s) s on true where d.before is not null),
  x as (select p.portfolio_id, p.now, a as new, b as old from p left join s a on a.portfolio_id = p.portfolio_id and a.snapshot_date = p.now left join s b on b.portfolio_id = p.portfolio_id and b.snapshot_date = p.before),
  c as (select portfolio_id, now, 'added' as change_kind, 'record' as field_name from x where new.portfolio_id is not null and old.portfolio_id is null union all select portfolio_id, now, 'removed', 'record' from x where new.portfolio_id is null and old.portfolio_id is not null
    union all {' union all '.join(f"select portfolio_id, now, 'changed', '{f}' from x where new.portfolio_id is not null and old.portfolio_id is not null and new.{f} is distinct from old.{f}" for f in ('project_name', 'dca_ipa', 'wlc_baseline_gbp_m', 'end_date'))})"""
SQL = {
    "p5_found": f"with {_CHANGES} select portfolio_id, cast(now as varchar) as snapshot_date, change_kind, field_name from c",
    "p5_counts": f"with {_CHANGES} select cast(now as varchar) as snapshot_date, change_kind, field_name, count(*) as n from c group by 1, 2, 3",
}
