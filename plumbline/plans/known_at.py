"""Problem 1: attributes as known at event time."""

from pyspark.sql import functions as F

from ..operators.asof import known_attributes
from ..session import table


def _known(spark, sf_dir, with_values):
    return known_attributes(
        table(spark, sf_dir, "predictions"),
        table(spark, sf_dir, "exp2_holder_gaps"),
        table(spark, sf_dir, "action_ledger"),
        table(spark, sf_dir, "rated_projects"),
        table(spark, sf_dir, "project_attributes"),
        table(spark, sf_dir, "pad_ieg_join_dictionary"),
        with_values=with_values,
    )


def p1_found(spark, sf_dir):
    return _known(spark, sf_dir, False)


def p1_values(spark, sf_dir):
    """Known events per attribute, with the sum of the numeric values as they were known."""
    value = F.when(
        F.col("attribute").isin("n_holders", "potential_total_value_of_award"), F.col("value_text").try_cast("double")
    )
    return (
        _known(spark, sf_dir, True)
        .groupBy("attribute")
        .agg(F.count("*").alias("n_known"), F.round(F.sum(value.cast("decimal(30,2)")), 2).cast("double").alias("sum_value"))
    )


_FOUND = """
with asked as (select distinct prediction_id, vehicle, label, horizon, contract_award_unique_key, predicted_at from predictions),
a as (
  select 'n_holders' as attribute, cast(p.prediction_id as varchar) as event_id, g.version_id,
         cast(g.n_holders as double) as value
  from asked p join exp2_holder_gaps g using (vehicle, label, horizon)
  where g.valid_from <= cast(p.predicted_at as date) and g.recorded_at <= p.predicted_at
  qualify row_number() over (partition by p.prediction_id order by g.valid_from desc, g.recorded_at desc, g.version_id desc) = 1),
b as (
  select 'potential_total_value_of_award' as attribute, cast(p.prediction_id as varchar) as event_id, l.action_id as version_id,
         l.potential_total_value_of_award as value
  from asked p join action_ledger l using (contract_award_unique_key)
  where l.potential_total_value_of_award is not null and l.last_modified_date is not null
    and l.action_date <= cast(p.predicted_at as date) and l.last_modified_date <= p.predicted_at
  qualify row_number() over (partition by p.prediction_id order by l.action_date desc, l.last_modified_date desc, l.action_id desc) = 1),
c as (
  select d.column_name as attribute, r.projectid as event_id, v.version_id, null::double as value
  from (select distinct projectid, boardapprovaldate from rated_projects) r
  join project_attributes v on v.projectid = r.projectid
  join (select distinct column_name from pad_ieg_join_dictionary where known_at_board_approval) d
    on lower(trim(v.column_name)) = lower(trim(d.column_name))
  where v.value_text is not null and v.valid_from <= r.boardapprovaldate and v.recorded_on <= r.boardapprovaldate
  qualify row_number() over (partition by r.projectid, r.boardapprovaldate, d.column_name
                             order by v.valid_from desc, v.recorded_on desc, v.version_id desc) = 1),
found as (select * from a union all select * from b union all select * from c)
"""

QUERIES = {"p1_found": p1_found, "p1_values": p1_values}
SQL = {
    "p1_found": _FOUND + "select attribute, event_id, version_id from found",
    "p1_values": _FOUND
    + "select attribute, count(*) as n_known, cast(round(sum(cast(value as decimal(30,2))), 2) as double) as sum_value "
    "from found group by attribute",
}
