"""Problem 7: quantities recorded in different units."""

from pyspark.sql import functions as F

from ..operators.quantities import amounts_in_pounds, foreign_amounts
from ..session import table


def p7_found(spark, sf_dir):
    return foreign_amounts(table(spark, sf_dir, "panel_duplicates"))


def p7_totals(spark, sf_dir):
    """Amounts and their total in pounds by field and the unit they were entered in."""
    amounts = amounts_in_pounds(table(spark, sf_dir, "panel_duplicates"), ["row_id"])
    return amounts.groupBy("field_name", "unit_factor").agg(
        F.count("*").alias("n_amounts"), F.sum("pounds").alias("total_pounds")
    )


QUERIES = {"p7_found": p7_found, "p7_totals": p7_totals}

_NUM = "[0-9][0-9,]*(?:\\.[0-9]+)?"
_VALUE = "try_cast(replace({0}, ',', '') as decimal(24,6))"


def unit_sql(text: str) -> str:
    """The factor of a unit text, by patterns."""
    return f"""case when regexp_matches({text}, '(?i)billion|bn|[0-9 £]b\\b') then 1e9 when regexp_matches({text}, '(?i)thousand|£\\s?''?000|£\\s?k|[0-9 £]k\\b') then 1e3
      when regexp_matches({text}, '(?i)million|mn\\b|[0-9 £]m\\b') then 1e6 when regexp_matches({text}, '(?i)£|gbp|pound') then 1.0 end"""


#: The row's note on the unit of its bare figures.
NOTE_SQL = """case when regexp_matches(wlc_narrative, '(?i)figures[^.]*£000|thousands of pounds|amounts shown in £k|values are £ thousands') then 1e3 when regexp_matches(wlc_narrative, '(?i)amounts in £ billion|billions of pounds\\.') then 1e9
  when regexp_matches(wlc_narrative, '(?i)whole pounds|nearest pound|entered in £, not') then 1.0 end"""


def cell_sql(column: str) -> tuple[str, str]:
    """(number, own factor) of a money cell."""
    bare = f"regexp_replace(trim({column}), '(?i)£''000 |\\(£000\\)', '', 'g')"
    number = _VALUE.format(f"nullif(regexp_extract({bare}, '(?i)^[^0-9.,]*({_NUM})[^0-9]*$', 1), '')")
    return number, unit_sql(f"trim({column})")


_LIFE = "(?i)(?:\\bwlc\\b|whole[\\s-]*life|life[\\s-]?cycle|life[\\s-]?time|over (?:its |the )?life)"
_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
_AMOUNTS = f"""a as (select row_id, 'wlc_baseline_gbp_m' as field_name, {cell_sql('wlc_baseline_gbp_m')[0]} as v, {cell_sql('wlc_baseline_gbp_m')[1]} as own, {NOTE_SQL} as note from panel_duplicates
    union all select row_id, 'fy_forecast_gbp_m', {cell_sql('fy_forecast_gbp_m')[0]}, {cell_sql('fy_forecast_gbp_m')[1]}, {NOTE_SQL} from panel_duplicates
    union all select row_id, 'wlc_narrative', case {' '.join(f"when lower(w) = '{x}' then {i}" for i, x in enumerate(_WORDS, 1))} else {_VALUE.format("nullif(n, '')")} end, case when w <> '' then 1e9 else {unit_sql("b || n || u")} end, note
      from (select row_id, {NOTE_SQL} as note, regexp_extract(wlc_narrative, '{_LIFE}[^0-9£.]*?\\b({'|'.join(_WORDS)}) billion\\b', 1) as w,
        regexp_extract(wlc_narrative, '{_LIFE}[^0-9£.]*?(£''000 |GBP |£)?({_NUM})(?: ?(?:\\(£000\\)|£k|(?:thousand|million|billion|mn|bn|m|b|k|gbp|pounds)\\b))?', 1) as b, regexp_extract(wlc_narrative, '{_LIFE}[^0-9£.]*?(?:£''000 |GBP |£)?({_NUM})', 1) as n,
        regexp_extract(wlc_narrative, '{_LIFE}[^0-9£.]*?(?:£''000 |GBP |£)?{_NUM}( ?(?:\\(£000\\)|£k|(?:thousand|million|billion|mn|bn|m|b|k|gbp|pounds)\\b))', 1) as u from panel_duplicates)),
  f as (select row_id, field_name, v, coalesce(own, note, case when v >= 500000 then 1.0 else 1e6 end) as factor from a where v is not null)"""
SQL = {
    "p7_found": f"with {_AMOUNTS} select row_id, field_name, cast(round(v * cast(factor as decimal(20,3)), 0) as bigint) as pounds from f where factor <> 1e6",
    "p7_totals": f"with {_AMOUNTS} select field_name, cast(factor as double) as unit_factor, count(*) as n_amounts, cast(sum(cast(round(v * cast(factor as decimal(20,3)), 0) as bigint)) as bigint) as total_pounds from f group by 1, 2",
}
