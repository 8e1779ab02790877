"""Problem 2: deeply nested semi-structured records."""

from pyspark.sql import functions as F

from ..operators.nested import distinct_links, latest_links
from ..session import table


def p2_found(spark, sf_dir):
    return distinct_links(latest_links(table(spark, sf_dir, "tender_records")))


def p2_tables(spark, sf_dir):
    """The flat tables with their common fields: one row per child, linked to its parent and object."""
    rows = latest_links(table(spark, sf_dir, "tender_records"), payload=True)
    field = lambda path: F.get_json_object("payload", path)
    is_object = F.col("child_table") != "rationale_types"
    return rows.select(
        "child_table",
        "object_id",
        "parent_id",
        "child_id",
        "ordinal",
        F.when(is_object, field("$.status")).alias("status"),
        F.when(is_object, F.coalesce(field("$.date"), field("$.dateSigned"))).alias("dated"),
        F.when(is_object, field("$.value.amount").try_cast("double")).alias("amount"),
    )


QUERIES = {"p2_found": p2_found, "p2_tables": p2_tables}


def _kids(held: str, child_id: str | None) -> str:
    """DuckDB list of the children held under a key, whatever their shape."""
    leaf = f"json_exists({held}, '$.{child_id}') or len(list_filter(json_extract({held}, '$.*'), lambda v: json_type(v) not in ('OBJECT', 'ARRAY'))) > 0" if child_id else "false"
    single = f"when json_type({held}) = 'VARCHAR' then [{held}]" if not child_id else ""
    return f"case when json_type({held}) = 'ARRAY' then json_extract({held}, '$[*]') when json_type({held}) = 'OBJECT' then case when {leaf} then [{held}] else json_extract({held}, '$.*') end {single} end"


_DOCS = """a as (select record_id, object_id, try_cast(date_modified as timestamptz) as dated, fetched_at, try_cast(body as json) as j from tender_records),
  b as (select * replace (case when json_type(j) = 'VARCHAR' then try_cast(j->>'$' as json) else j end as j) from a),
  c as (select * replace (case when json_type(j) = 'OBJECT' and not json_exists(j, '$.id') then coalesce(j->'$.response.data', j->'$.data', j) else j end as j) from b),
  d as (select * from c where json_type(j) = 'OBJECT' qualify row_number() over (partition by coalesce(object_id, j->>'$.id') order by dated desc nulls last, fetched_at desc nulls last, record_id desc) = 1)"""
SQL = {
    "p2_found": f"""with {_DOCS},
      bids as (select unnest({_kids("(j->'$.bids')", 'id')}) as x from d), aw as (select j->>'$.id' as p, unnest({_kids("(j->'$.awards')", 'id')}) as x from d), ch as (select j->>'$.id' as p, unnest({_kids("(j->'$.changes')", 'id')}) as x from d),
      lv as (select x->>'$.id' as p, unnest({_kids("(x->'$.lotValues')", 'relatedLot')}) as y from bids), rt as (select x->>'$.id' as p, unnest({_kids("(x->'$.rationaleTypes')", None)}) as y from ch),
      u as (select 'lot_values' as t, p, y->>'$.relatedLot' as c from lv where json_type(y) = 'OBJECT' union all select 'awards', p, x->>'$.id' from aw where json_type(x) = 'OBJECT' union all select 'changes', p, x->>'$.id' from ch where json_type(x) = 'OBJECT'
        union all select 'rationale_types', p, trim(y->>'$') from rt where json_type(y) <> 'NULL')
      select distinct t as child_table, p as parent_id, c as child_id from u where trim(p) <> '' and trim(c) <> ''""",
    "p2_tables": f"""with {_DOCS}, o as (select coalesce(object_id, j->>'$.id') as object_id, j->>'$.id' as rid, j from d),
      bids as (select object_id, x from (select object_id, unnest({_kids("(j->'$.bids')", 'id')}) as x from o) where json_type(x) = 'OBJECT'), ch0 as (select object_id, rid as p, list_filter({_kids("(j->'$.changes')", 'id')}, lambda v: json_type(v) = 'OBJECT') as l from o),
      lv as (select object_id, x->>'$.id' as p, list_filter({_kids("(x->'$.lotValues')", 'relatedLot')}, lambda v: json_type(v) = 'OBJECT') as l from bids), aw as (select object_id, rid as p, list_filter({_kids("(j->'$.awards')", 'id')}, lambda v: json_type(v) = 'OBJECT') as l from o),
      ch as (select object_id, unnest(l) as x from ch0), rt as (select object_id, x->>'$.id' as p, {_kids("(x->'$.rationaleTypes')", None)} as l from ch),
      u as (select 'lot_values' as t, object_id, p, unnest(l) as y, generate_subscripts(l, 1) - 1 as k, 'relatedLot' as key from lv union all select 'awards', object_id, p, unnest(l), generate_subscripts(l, 1) - 1, 'id' from aw
        union all select 'changes', object_id, p, unnest(l), generate_subscripts(l, 1) - 1, 'id' from ch0 union all select 'rationale_types', object_id, p, unnest(l), generate_subscripts(l, 1) - 1, null from rt),
      w as (select t, object_id, p, case when key is null then trim(y->>'$') else y->>('$.' || key) end as c, k, y, key is not null as obj from u)
      select t as child_table, object_id, p as parent_id, c as child_id, cast(k as int) as ordinal, case when obj then y->>'$.status' end as status, case when obj then coalesce(y->>'$.date', y->>'$.dateSigned') end as dated, case when obj then try_cast(y->>'$.value.amount' as double) end as amount
      from w where trim(p) <> '' and trim(c) <> ''""",
}
