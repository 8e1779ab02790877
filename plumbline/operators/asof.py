"""As-of joins: what was known about an entity at the time of an event.

A version of an attribute is *available* from the moment at which it is both valid and
recorded.  Among the available versions the one with the greatest rank (latest validity, then
latest recording, then greatest id) counts.  Because availability is a single point in time,
the two-clock lookup is a running maximum over the merged timeline of versions and events, and
a running maximum can be cut anywhere: a piece only needs the maximum of all that came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Timeline buckets that are counted to find hot entities; the count is a table of this many rows.
LOAD_BUCKETS = 4096
#: A bucket is hot, and is cut into pieces of that size, when it holds this many times the mean load.
HOT_FACTOR = 2.0
#: Fewer rows than this are never cut: a piece costs more than it spares.
MIN_HOT_ROWS = 256


def as_of_latest(
    events: DataFrame,
    versions: DataFrame,
    *,
    key: list[str],
    event_time: str,
    available_at: Column,
    rank: list[str],
    keep: list[str],
    hot_factor: float = HOT_FACTOR,
    min_hot_rows: int = MIN_HOT_ROWS,
) -> DataFrame:
    """Each event row with the columns ``keep`` of the version known at its time, in a struct
    ``version`` (null where none was known).

    key          equality columns, present on both sides
    event_time   timestamp column of ``events``
    available_at expression over ``versions``: when a version became usable
    rank         columns of ``versions`` by which the greatest available version is chosen; they
                 must order the versions of one key totally, so end them with an id
    keep         columns of ``versions`` to bring over

    Entities whose timeline is hot are sharded by time: shard bounds are quantiles of the
    timeline, every shard starts with a carry-in row that holds the greatest version of all
    earlier shards, and each shard is merged by itself.  An instant that is a bound is a shard of its own;
    one that takes several pieces has its events dealt by a hash of the event, each piece with the same
    carry-in row.  The result does not depend on the sharding.  Defined cases: a version or event with a null in its key or time takes no part
    (such events come out with a null version); a version available exactly at the event's time
    counts; repeated versions change nothing; repeated events each come out; columns of the two
    sides may clash, since versions come back inside one struct.
    """
    event_columns = list(events.columns)
    version_struct = F.struct(*[F.col(c) for c in rank], *[F.col(c) for c in keep if c not in rank])
    right = (
        versions.withColumn("__t", available_at)
        .where(F.col("__t").isNotNull())
        .select(
            F.xxhash64(*key).alias("__h"),
            F.struct(*key).alias("__k"),
            F.col("__t"),
            F.lit(0).alias("__o"),
            version_struct.alias("__v"),
        )
    )
    for name in key:
        right = right.where(F.col(f"__k.{name}").isNotNull())
    left = events.select(
        F.xxhash64(*key).alias("__h"),
        F.struct(*key).alias("__k"),
        F.col(event_time).alias("__t"),
        F.lit(1).alias("__o"),
        F.struct(*event_columns).alias("__e"),
    )
    complete = F.col("__t").isNotNull()
    for name in key:
        complete = complete & F.col(f"__k.{name}").isNotNull()
    v_type = right.schema["__v"].dataType
    e_type = left.schema["__e"].dataType
    merged = right.withColumn("__e", F.lit(None).cast(e_type)).unionByName(
        left.where(complete).withColumn("__v", F.lit(None).cast(v_type))
    )

    bounds = _hot_bounds(merged, hot_factor, min_hot_rows)
    if bounds is None:
        sharded = merged.withColumn("__s", F.lit(0)).withColumn("__p", F.lit(0))
    else:
        sharded = _shard(merged, bounds)
    timeline = Window.partitionBy("__k", "__s", "__p").orderBy("__t", "__o").rowsBetween(Window.unboundedPreceding, 0)
    matched = (
        sharded.withColumn("version", F.max("__v").over(timeline))
        .where(F.col("__o") == 1)
        .select("__e.*", "version")
    )
    incomplete = left.where(~F.coalesce(complete, F.lit(False))).select(
        "__e.*", F.lit(None).cast(v_type).alias("version")
    )
    return matched.unionByName(incomplete)


def _hot_bounds(merged: DataFrame, hot_factor: float, min_hot_rows: int) -> DataFrame | None:
    """(__b, __cuts): for each hot bucket its bounds in order, with how many pieces fall on each; None without any.

    Only a histogram of LOAD_BUCKETS counts, combined before the shuffle, reaches the driver.  The bounds are at most
    LOAD_BUCKETS / hot_factor rows of as many bounds, and are written down, since approximate quantiles
    may differ when they are worked out again.
    """
    bucket = F.pmod("__h", F.lit(LOAD_BUCKETS)).cast("int")
    counts = {r["__b"]: r["n"] for r in merged.groupBy(bucket.alias("__b")).agg(F.count("*").alias("n")).collect()}
    target = max(1.0, float(min_hot_rows), hot_factor * sum(counts.values()) / LOAD_BUCKETS)
    hot = {b: int(-(-n // target)) for b, n in counts.items() if n > target}
    if not hot:
        return None
    pieces = max(hot.values())
    steps = [i / pieces for i in range(1, pieces)]
    shares = merged.sparkSession.createDataFrame(list(hot.items()), "__b int, __pieces int")
    quantiles = (
        merged.withColumn("__b", bucket)
        .join(F.broadcast(shares), "__b")
        .groupBy("__b")
        .agg(F.percentile_approx(_micros(), steps, max(10_000, 10 * pieces)).alias("__q"), F.max("__pieces").alias("__pieces"))
    )
    # a bucket of fewer pieces takes every so manieth bound
    stride = F.greatest(F.lit(1), F.floor(F.lit(pieces) / F.col("__pieces"))).cast("int")
    own = F.transform(F.sequence(stride, F.lit(pieces - 1), stride), lambda i: F.element_at("__q", i))
    own = F.when(stride <= pieces - 1, own).otherwise(F.slice("__q", F.lit(1), F.lit(1)))
    cuts = F.transform(F.array_distinct("__own"), lambda t: F.struct(t.alias("t"), F.size(F.filter("__own", lambda x: x == t)).alias("n")))
    return cut_lineage(quantiles.select("__b", own.alias("__own")).select("__b", cuts.alias("__cuts")))


def _micros() -> Column:
    return F.unix_micros(F.col("__t").cast("timestamp"))


def _shard(merged: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows with their shard and piece, and for every shard of a hot entity that has events a carry-in row.

    Shards 0, 2, 4, ... lie between the bounds, shards 1, 3, 5, ... are the bounds themselves.  ``bounds`` may be
    broadcast whatever the size of the data.
    """
    marked = merged.withColumn("__b", F.pmod("__h", F.lit(LOAD_BUCKETS)).cast("int")).join(F.broadcast(bounds), "__b", "left")
    marked = marked.withColumn("__m", _micros())
    on = F.get(F.filter("__cuts", lambda c: c["t"] == F.col("__m")), 0)["n"]
    below = F.size(F.filter("__cuts", lambda c: c["t"] < F.col("__m")))
    marked = marked.withColumn("__n", on).withColumn(
        "__s", F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(2 * below + F.col("__n").isNotNull().cast("int"))
    )
    hot, instant = F.col("__cuts").isNotNull(), F.col("__n").isNotNull()
    dealt = F.when(F.col("__n") > 1, F.pmod(F.xxhash64("__e"), F.col("__n"))).otherwise(F.lit(0)).cast("int")
    # the versions of an instant reach its events in the carry-in row
    rows = marked.where(~(instant & (F.col("__o") == 0))).withColumn("__p", dealt).drop("__b", "__cuts", "__m", "__n")
    summary = (
        marked.where(hot)
        .groupBy("__h", "__k", "__s")
        .agg(F.max("__v").alias("__v"), F.min("__t").alias("__t"), F.max("__o").alias("__asked"), F.max(F.coalesce("__n", F.lit(1))).alias("__n"))
    )
    so_far = Window.partitionBy("__k").orderBy("__s")
    before, up_to = so_far.rowsBetween(Window.unboundedPreceding, -1), so_far.rowsBetween(Window.unboundedPreceding, 0)
    carry = (
        summary.withColumn("__v", F.when(F.col("__s") % 2 == 1, F.max("__v").over(up_to)).otherwise(F.max("__v").over(before)))
        .where(F.col("__v").isNotNull() & (F.col("__asked") == 1))
        .withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
        .withColumn("__o", F.lit(-1))
        .withColumn("__e", F.lit(None).cast(merged.schema["__e"].dataType))
    )
    return rows.unionByName(carry.select(*rows.columns))


def known_attributes(
    predictions: DataFrame,
    holder_gaps: DataFrame,
    ledger: DataFrame,
    approvals: DataFrame,
    attributes: DataFrame,
    dictionary: DataFrame,
    with_values: bool = True,
    **hot,
) -> DataFrame:
    """(attribute, event_id, version_id[, value_text]) of everything known at its event's time.

    Covers the three kinds of events of the project: ``n_holders`` and
    ``potential_total_value_of_award`` at each prediction, and every attribute that the dictionary
    calls known at board approval at each project's approval date.  Events without a known version
    give no row; redelivered events count once; a null date, key or value takes no part.
    """
    asked = predictions.select(
        F.col("prediction_id").cast("string").alias("event_id"),
        "vehicle",
        "label",
        "horizon",
        "contract_award_unique_key",
        F.col("predicted_at").cast("timestamp_ntz").alias("at"),
    ).dropDuplicates()
    by_vehicle = asked.where("vehicle is not null and label is not null and horizon is not null").select(
        F.lit("n_holders").alias("attribute"),
        F.concat_ws("\u0001", "vehicle", "label", F.col("horizon").cast("string")).alias("entity"),
        "event_id",
        "at",
    )
    by_award = asked.where("contract_award_unique_key is not null").select(
        F.lit("potential_total_value_of_award").alias("attribute"),
        F.col("contract_award_unique_key").alias("entity"),
        "event_id",
        "at",
    )
    def version(frame, attribute, entity, valid, recorded, ident, value):
        return frame.select(
            attribute.alias("attribute"),
            entity.alias("entity"),
            valid.cast("timestamp_ntz").alias("valid_from"),
            recorded.cast("timestamp_ntz").alias("recorded_at"),
            F.col(ident).alias("version_id"),
            value.cast("string").alias("value_text"),
        )

    gaps = version(
        holder_gaps.where("vehicle is not null and label is not null and horizon is not null"),
        F.lit("n_holders"),
        F.concat_ws("\u0001", "vehicle", "label", F.col("horizon").cast("string")),
        F.col("valid_from"),
        F.col("recorded_at"),
        "version_id",
        F.col("n_holders"),
    )
    awards = version(
        ledger.where("potential_total_value_of_award is not null and last_modified_date is not null"),
        F.lit("potential_total_value_of_award"),
        F.col("contract_award_unique_key"),
        F.col("action_date"),
        F.col("last_modified_date"),
        "action_id",
        F.col("potential_total_value_of_award"),
    )
    # the names as the dictionary has them, one version per name that is written alike
    named = dictionary.where("known_at_board_approval and column_name is not null").select(F.col("column_name").alias("canonical")).distinct()
    named = named.withColumn("written", F.lower(F.trim("canonical")))
    told = attributes.where("value_text is not null and projectid is not null").withColumn("written", F.lower(F.trim("column_name")))
    projects = version(
        told.join(named, "written"),
        F.col("canonical"),
        F.col("projectid"),
        F.col("valid_from"),
        F.col("recorded_on"),
        "version_id",
        F.col("value_text"),
    )
    # an approval asks for those attributes only of which its project has a version
    kept_of = projects.select("attribute", "entity").distinct()
    approved = (
        approvals.where("projectid is not null and boardapprovaldate is not null")
        .select(F.col("projectid").alias("entity"), F.col("boardapprovaldate").cast("timestamp_ntz").alias("at"))
        .dropDuplicates()
    )
    by_project = approved.join(kept_of, "entity").select("attribute", "entity", F.col("entity").alias("event_id"), "at")
    events = by_vehicle.unionByName(by_award).unionByName(by_project)
    versions = (
        gaps.unionByName(awards)
        .unionByName(projects)
        .where("valid_from is not null and recorded_at is not null and version_id is not null")
    )
    found = as_of_latest(
        events,
        versions,
        key=["attribute", "entity"],
        event_time="at",
        available_at=F.greatest("valid_from", "recorded_at"),
        rank=["valid_from", "recorded_at", "version_id"],
        keep=["value_text"] if with_values else [],
        **hot,
    )
    values = [F.col("version.value_text").alias("value_text")] if with_values else []
    return found.where("version is not null").select(
        "attribute", "event_id", F.col("version.version_id").alias("version_id"), *values
    )

