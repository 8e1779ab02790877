"""Streaming operators on their batch side: the same functions give the same results as the stream."""

from pyspark.sql import functions as F

from ..session import table
from ..streaming import feeds


def stream_windows(spark, sf_dir):
    return feeds.windowed_counts(table(spark, sf_dir, "events"), "ts", ["event_type"]).select(F.to_date("window_start").alias("day"), "event_type", "n")


def stream_sliding(spark, sf_dir):
    rows = feeds.windowed_counts(table(spark, sf_dir, "events"), "ts", [], "2 days", "1 day")
    return rows.select(F.to_date("window_start").alias("day"), "n")


def stream_sessions(spark, sf_dir):
    """How many sessions of each length users have, with gaps of six hours."""
    rows = feeds.session_counts(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")
    return rows.groupBy(F.col("n").alias("n_events")).agg(F.count("*").alias("n_sessions"))


QUERIES = {f.__name__: f for f in (stream_windows, stream_sliding, stream_sessions)}
SQL = {
    "stream_windows": "select cast(ts as date) as day, event_type, count(*) as n from events group by 1, 2",
    "stream_sliding": "with s as (select cast(ts as date) + cast(unnest([0, -1]) as int) as day from events) select day, count(*) as n from s group by 1",
    "stream_sessions": """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as s from events), k as (select user_id, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from g),
      c as (select user_id, k, count(*) as n from k group by 1, 2) select n as n_events, count(*) as n_sessions from c group by 1""",
}
