"""Problem 6: schemas that drift between files."""

from pyspark.sql import functions as F

from ..operators.drift import _cells, _with_fields, alternatives, branch_counts, newest_rows, schema_changes, unified_table
from ..session import table


def _tables(spark, sf_dir):
    return table(spark, sf_dir, "publication_rows"), table(spark, sf_dir, "table_calendar_validation")


def p6_found(spark, sf_dir):
    return schema_changes(*_tables(spark, sf_dir))


def p6_rows(spark, sf_dir):
    """The one table itself: every row of every file with all canonical columns, typed branches and ``more``."""
    return unified_table(*_tables(spark, sf_dir))


def p6_table(spark, sf_dir):
    """Filled cells and sums per canonical column of the one table, which ``p6_rows`` gives whole; ``p6_branches`` counts the cells of its other columns."""
    rows = unified_table(*_tables(spark, sf_dir))
    cells = [c for c in rows.columns if c not in ("publication_slug", "row_no", "more") and "__" not in c]
    stacked = rows.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).isNotNull().alias("filled"), (F.col(c) if c.endswith("_value") else F.lit(None).cast("double")).alias("v")) for c in cells])
        ).alias("x")
    )
    return stacked.groupBy("x.column_name").agg(
        F.count_if("x.filled").alias("n_filled"), F.round(F.sum(F.col("x.v").cast("decimal(30,4)")), 2).cast("double").alias("sum_value")
    )


def p6_branches(spark, sf_dir):
    """The union over all files: cells per field and alternative, each row of a file once."""
    rows, _ = _tables(spark, sf_dir)
    cells = _with_fields(_cells(newest_rows(rows), ["publication_slug", "row_no"]))
    return branch_counts(cells).select("field_name", F.col("type").alias("json_type"), "n")


def p6_alternatives(spark, sf_dir):
    return alternatives(*_tables(spark, sf_dir))


QUERIES = {"p6_found": p6_found, "p6_rows": p6_rows, "p6_table": p6_table, "p6_branches": p6_branches, "p6_alternatives": p6_alternatives}

#: The rules by which the SQL tells a header's field, in order; written out, so that a change of the operator's shows.
_RULES = {
    "evaluation_plan": ["evaluation"], "benefits_baseline_gbp_m": ["benefit"], "wlc_narrative": ["comment|remark|note|narrative", "cost|life|wlc"], "wlc_baseline_gbp_m": ["wlc|life|full cost|all years"],
    "fy_forecast_gbp_m": ["forecast|outturn|expected spend"], "end_date": ["finish|end|close|completion"], "start_date": ["start|begun|begin|commence"], "fy_baseline_gbp_m": ["plan|budget|baseline", "year|spend"],
    "portfolio_id": ["identifier|ref|id"], "dca_ipa": ["confidence|rag|rating|dca"], "department": ["department|dept|sponsor|body|ministry|organisation"], "description": ["aim|about|scope|outline|summary|description|purpose"],
    "project_name": ["project|scheme|programme"],
}
_FIELD = "case " + " ".join("when " + " and ".join(f"regexp_matches(stem, '\\b({g})')" for g in groups) + f" then '{name}'" for name, groups in _RULES.items()) + " end"
_YEAR = "\\b(fy\\s*)?(\\d{4}|\\d{2})\\s*[/\\-–]\\s*(\\d{4}|\\d{2})\\b|\\bfy\\s*\\d{2,4}\\b|\\b(19|20)\\d{2}\\b"
_STEM = (
    "trim(regexp_replace(regexp_replace(regexp_replace(lower(replace(key, '_', ' ')), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '"
    + _YEAR
    + "', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"
)
_NEWEST = f"""r as (select publication_slug, row_no, record from publication_rows where publication_slug is not null qualify row_number() over (partition by publication_slug, row_no order by delivered_at desc, record_id desc) = 1),
  j as (select publication_slug, row_no, try_cast(record as json) as j from r where json_type(try_cast(record as json)) = 'OBJECT'), k as (select publication_slug, row_no, unnest(json_keys(j)) as key, j from j),
  e as (select publication_slug, row_no, key, json_extract(j, '$."' || replace(key, '"', '\\"') || '"') as v from k), s as (select *, json_type(v) as kind, {_STEM} as stem from e where json_type(v) <> 'NULL'),
  c as (select * from (select publication_slug, row_no, key, v, case when kind = 'VARCHAR' then 'string' when kind = 'BOOLEAN' then 'boolean' when kind = 'ARRAY' then 'array' when kind = 'OBJECT' then 'object' else 'number' end as type, {_FIELD} as field_name from s) where field_name is not null)"""
SQL = {
    "p6_found": f"""with j as (select publication_slug, try_cast(record as json) as j from publication_rows where publication_slug is not null and try_cast(record as json) is not null and json_type(try_cast(record as json)) = 'OBJECT'),
      k as (select publication_slug, unnest(json_keys(j)) as key, j from j), e as (select distinct publication_slug, key, json_type(j, '$."' || replace(key, '"', '\\"') || '"') as kind from k),
      s as (select publication_slug, {_STEM} as stem, case when kind = 'VARCHAR' then 'string' when kind = 'BOOLEAN' then 'boolean' when kind = 'ARRAY' then 'array' when kind = 'OBJECT' then 'object' else 'number' end as type from e where kind <> 'NULL'),
      f as (select publication_slug, {_FIELD} as field_name, stem, type from s),
      m as (select publication_slug, 'money_header_implies' as field_name, '' as stem, case when regexp_full_match(trim(money_header_implies), '\\d{{4,6}}(\\.0*)?') then 'serial'
          when regexp_full_match(trim(money_header_implies), '(?i)(fy\\s*)?(\\d{{4}}|\\d{{2}})\\s*[/\\-]\\s*(\\d{{4}}|\\d{{2}})') then 'financial year' else 'date' end as type from table_calendar_validation where trim(money_header_implies) <> ''),
      u as (select publication_slug, field_name, list_sort(list_distinct(list(stem))) as stems, list_sort(list_distinct(list(type))) as types from (select * from f where field_name is not null union all select * from m) group by 1, 2),
      c as (select distinct publishing_body, publication_year, publication_slug from table_calendar_validation where publishing_body is not null and publication_year is not null and publication_slug is not null),
      p as (select publication_slug as cur, lag(publication_slug) over (partition by publishing_body order by publication_year, publication_slug) as before from c),
      d as (select distinct cur, before, field_name from p join u on u.publication_slug in (cur, before) where before is not null),
      x as (select d.cur, d.field_name, n.stems as ns, o.stems as os, n.types as nt, o.types as ot from d left join u n on n.publication_slug = d.cur and n.field_name = d.field_name left join u o on o.publication_slug = d.before and o.field_name = d.field_name)
      select cur as publication_slug, field_name, 'added' as change_kind from x where os is null union all select cur, field_name, 'removed' from x where ns is null
      union all select cur, field_name, 'renamed' from x where ns <> os union all select cur, field_name, 'type_changed' from x where nt <> ot""",
    "p6_branches": f"""with {_NEWEST} select field_name, type as json_type, count(*) as n from c group by 1, 2""",
    "p6_table": f"""with {_NEWEST}, u as (select * from c qualify row_number() over (partition by publication_slug, row_no, field_name order by key) = 1),
      v as (select *, case when type = 'array' then array_to_string(json_extract_string(v, '$[*]'), ' ') when type = 'object' then cast(v as varchar) else v->>'$' end as t from u),
      w as (select *, case when type = 'object' then try_cast(v->>'$.amount' as double) when type = 'number' then try_cast(t as double) when regexp_full_match(trim(t), '(?i)[^0-9.,]*[0-9][0-9,]*(\\.[0-9]+)?[^0-9]*') then try_cast(replace(regexp_extract(t, '[0-9][0-9,]*(\\.[0-9]+)?'), ',', '') as double) end as a from v),
      m as (select field_name || '_value' as column_name, a * case when type = 'object' and v->>'$.unit' = '£k' then 1e-3 when type = 'object' and v->>'$.unit' = '£bn' then 1e3 when type = 'object' and v->>'$.unit' in ('£', 'GBP') then 1e-6
          when type = 'string' and regexp_matches(t, '(?i)[0-9]\\s*(bn|b|billion)\\b') then 1e3 when type = 'string' and regexp_matches(t, '(?i)[0-9]\\s*(k|thousand)\\b') then 1e-3 when type = 'string' and regexp_matches(t, '(?i)[0-9]\\s*(m|mn|million)\\b') then 1 when type = 'string' and regexp_matches(t, '£|GBP|pound') then 1e-6 else 1 end as x from w
        where field_name in ('fy_baseline_gbp_m', 'fy_forecast_gbp_m', 'wlc_baseline_gbp_m', 'benefits_baseline_gbp_m')),
      dt as (select field_name || '_date' as column_name, case when type = 'number' then date '1899-12-30' + try_cast(t as int) else cast(try_strptime(trim(t), ['%Y-%m-%d', '%d.%m.%Y', '%d/%m/%Y', '%Y%m%d', '%d-%b-%y', '%d %B %Y', '%d %b %Y']) as date) end as x from v where field_name in ('start_date', 'end_date')),
      ev as (select case when type = 'boolean' then 1 when lower(trim(t)) not in ('', '-', 'n/a', 'tbc', 'xxx', 'not provided', 'see previous return') then 1 end as x from v where field_name = 'evaluation_plan'),
      im as (select publication_slug, max(money_header_implies) as x from table_calendar_validation group by 1),
      names as (select unnest(['evaluation_plan', 'benefits_baseline_gbp_m', 'wlc_narrative', 'wlc_baseline_gbp_m', 'fy_forecast_gbp_m', 'end_date', 'start_date', 'fy_baseline_gbp_m', 'portfolio_id', 'dca_ipa', 'department', 'description', 'project_name']) as n)
      select n as column_name, (select count(t) from v where field_name = n) as n_filled, cast(null as double) as sum_value from names
      union all select n || '_value', (select count(x) from m where column_name = n || '_value'), (select cast(round(sum(cast(x as decimal(30,4))), 2) as double) from m where column_name = n || '_value') from names where n in ('fy_baseline_gbp_m', 'fy_forecast_gbp_m', 'wlc_baseline_gbp_m', 'benefits_baseline_gbp_m')
      union all select n || '_date', (select count(x) from dt where column_name = n || '_date'), null from names where n in ('start_date', 'end_date') union all select 'evaluation_planned', (select count(x) from ev), null
      union all select 'money_header_implies', (select count(x) from r join im using (publication_slug)), null""",
}
