"""Changes between full snapshots: survivors per key, Merkle digests over hash ranges, row diffs.

Keys are put into hash ranges.  Per snapshot every range has a digest of its rows, the digests are
rolled up to a tree, and two snapshots are compared from the root down: only below nodes whose
digests differ is anything looked at, and rows are compared only in leaves that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import (
    cell_parts,
    day_first_date,
    is_cut_name,
    is_filler,
    note_unit,
    plain_name,
    pounds,
    rating,
    squeezed_name,
    unit_factor,
)
from ..session import cut_lineage

#: Leaves of the digest tree and children of a node; LEAVES is a power of FANOUT.
LEAVES = 65_536
FANOUT = 256
#: Most snapshots that are compared at once; their list is a broadcast of two rows each.
MOST_SNAPSHOTS = 100_000


def claim_order(kind: str = "source_kind", published: str = "published_at", row: str = "row_id") -> Column:
    """The order in which rows of one project and snapshot count: the least is the best.

    ``final`` before ``draft`` before anything else, then the latest publication (unknown last), then
    the smallest row id.
    """
    place = F.when(F.col(kind) == "final", 0).when(F.col(kind) == "draft", 1).otherwise(2)
    at = F.unix_micros(F.col(published).cast("timestamp"))
    return F.named_struct(F.lit("kind"), place, F.lit("published"), F.coalesce(-at, F.lit(2**62)), F.lit("row"), F.col(row))


def cut_names(names: DataFrame, entity: str, name: str) -> DataFrame:
    """(entity, name) of the names that are cut off inside a word.

    A name is cut off when it ends with a mark of continuation, inside a programme word, or when another
    name of the same entity goes on with a letter just where it stops.
    """
    distinct = names.select(entity, name).where(f"{name} is not null").distinct().withColumn("__p", plain_name(F.col(name)))
    plain = distinct.select(entity, "__p").distinct()
    # every beginning of a name that ends inside a word, to be met by equality
    begun = plain.where(F.length("__p") > 1).select(
        entity, "__p", F.explode(F.sequence(F.lit(1), F.length("__p") - 1)).alias("__n")
    )
    inside = begun.where(F.substring(F.col("__p"), F.col("__n"), F.lit(2)).rlike(r"^\p{L}\p{L}$")).select(
        entity, F.substring(F.col("__p"), F.lit(1), F.col("__n")).alias("__p")
    )
    met = plain.join(inside, [entity, "__p"], "left_semi").withColumn("__on", F.lit(True))
    return (
        distinct.join(met, [entity, "__p"], "left")
        .where(F.coalesce("__on", F.lit(False)) | is_cut_name(F.col(name)))
        .select(entity, name)
    )


def project_snapshots(panel: DataFrame) -> DataFrame:
    """(portfolio_id, snapshot_date, project_name, dca_ipa, wlc_baseline_gbp_m, end_date): one row per
    project and snapshot with the meaning of each field's best usable value, null where none is usable.

    Rows without portfolio_id or snapshot_date take no part.  Several rows of one project are
    reduced by partial minima before the shuffle, so a project with very many rows is no hot spot.
    """
    rows = panel.where("portfolio_id is not null and snapshot_date is not null")
    order = claim_order()
    amount = cell_parts(F.col("wlc_baseline_gbp_m"))
    meant = rows.select(
        "portfolio_id",
        "snapshot_date",
        order.alias("__order"),
        rating(F.col("dca_ipa")).alias("dca_ipa"),
        F.when(~is_filler(F.col("end_date")), F.coalesce(day_first_date(F.col("end_date")).cast("string"), F.trim("end_date"))).alias("end_date"),
        amount.alias("__amount"),
        note_unit(F.col("wlc_narrative")).alias("__note"),
    )
    priced = meant.withColumn("__own", unit_factor(F.col("__amount.unit"))).withColumn("__note", unit_factor(F.col("__note")))
    priced = priced.withColumn("wlc_baseline_gbp_m", pounds(F.col("__amount.number"), F.col("__own"), F.col("__note")))

    def best(name):
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col("__order"))).alias(name)

    others = priced.groupBy("portfolio_id", "snapshot_date").agg(best("dca_ipa"), best("wlc_baseline_gbp_m"), best("end_date"))
    named = (
        rows.where(~is_filler(F.col("project_name")))
        .groupBy("portfolio_id", "snapshot_date", "project_name")
        .agg(F.min(order).alias("__order"))
    )
    usable = named.join(cut_names(named, "portfolio_id", "project_name"), ["portfolio_id", "project_name"], "left_anti")
    names = usable.groupBy("portfolio_id", "snapshot_date").agg(
        F.min_by(squeezed_name(F.col("project_name")), "__order").alias("project_name")
    )
    return others.join(names, ["portfolio_id", "snapshot_date"], "left").select(
        "portfolio_id", "snapshot_date", "project_name", "dca_ipa", "wlc_baseline_gbp_m", "end_date"
    )


def differing_leaves(keyed: DataFrame, roles: DataFrame, snapshot: str, leaves: int, fanout: int) -> DataFrame:
    """(snapshot, __leaf): the leaves in which a snapshot differs from the one before.

    ``keyed`` has ``__leaf`` and ``__hash`` per row, ``roles`` says in which comparisons a snapshot takes part.  A leaf's
    digest is the sum of its row hashes and their exclusive or, which do not depend on the order of rows.  Both sides of a comparison
    stand in one row; the digest of a node is that of its children.  From the root down only children of nodes that
    differ are looked at.  The tree has at most one row per comparison and node, however many rows the snapshots have.
    """
    digest = keyed.groupBy(snapshot, "__leaf").agg(
        F.bit_xor("__hash").alias("x"), F.sum(F.shiftright("__hash", 32)).alias("s"), F.count("*").alias("n")
    ).select(F.col(snapshot).alias("__at"), F.col("__leaf").alias("node"), F.xxhash64("x", "s", "n").alias("digest"))

    def side(k, value):
        return F.max(F.when(F.col("side") == k, value))

    compared = digest.join(F.broadcast(roles), "__at").groupBy(snapshot, "node").agg(side(1, F.col("digest")).alias("new"), side(0, F.col("digest")).alias("old"))
    levels = [cut_lineage(compared)]
    width = leaves
    while width > 1:
        width = -(-width // fanout)
        both = [F.struct(F.bit_xor(F.xxhash64("node", c)).alias("x"), F.sum(F.shiftright(F.xxhash64("node", c), 32)).alias("s")) for c in ("new", "old")]
        up = levels[-1].groupBy(snapshot, F.floor(F.col("node") / fanout).cast("int").alias("node")).agg(F.xxhash64(both[0]).alias("new"), F.xxhash64(both[1]).alias("old"))
        levels.append(up)
    differs = ~F.col("new").eqNullSafe(F.col("old"))
    found = levels[-1].where(differs).select(snapshot, "node")
    for level in levels[-2::-1]:
        below = level.where(differs).select(snapshot, "node", F.floor(F.col("node") / fanout).cast("int").alias("parent"))
        found = below.join(found.withColumnRenamed("node", "parent"), [snapshot, "parent"], "left_semi").select(snapshot, "node")
    return found.withColumnRenamed("node", "__leaf")


def snapshot_changes(snapshots: DataFrame, key: str, snapshot: str, fields: list[str], leaves: int = LEAVES, fanout: int = FANOUT) -> DataFrame:
    """(key, snapshot, change_kind, field_name) from each snapshot to the next, dated by the later.

    ``added`` and ``removed`` have field_name ``record``; ``changed`` has the field, where null differs from
    any value.  Nothing is said of the first snapshot.  One row per key and snapshot is expected.  There may be at most
    MOST_SNAPSHOTS snapshots, since their dates are ordered and sent to every task.
    """
    keyed = cut_lineage(
        snapshots.withColumn("__leaf", F.pmod(F.xxhash64(key), F.lit(leaves)).cast("int")).withColumn("__hash", F.xxhash64(key, *fields, *[F.col(f).isNull() for f in fields]))
    )
    dates = [r[0] for r in keyed.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().limit(MOST_SNAPSHOTS + 1).collect()]
    if len(dates) > MOST_SNAPSHOTS:
        raise ValueError(f"more than {MOST_SNAPSHOTS} snapshots")
    dates.sort()
    taking = [(at, dated, k) for old, new in zip(dates, dates[1:], strict=False) for at, dated, k in ((new, new, 1), (old, new, 0))]
    kind = keyed.schema[snapshot].dataType.simpleString()
    roles = keyed.sparkSession.createDataFrame(taking, f"__at {kind}, `{snapshot}` {kind}, side int")
    differing = differing_leaves(keyed, roles, snapshot, leaves, fanout)
    value = F.struct(*fields)
    sides = (
        keyed.withColumnRenamed(snapshot, "__at")
        .join(F.broadcast(roles), "__at")
        .join(differing, [snapshot, "__leaf"], "left_semi")
        .select(key, snapshot, "side", value.alias("v"))
    )
    matched = sides.groupBy(key, snapshot).agg(
        F.max_by("v", F.when(F.col("side") == 1, 1)).alias("new"),
        F.max_by("v", F.when(F.col("side") == 0, 1)).alias("old"),
        F.max("side").alias("has_new"),
        F.min("side").alias("lacks_old"),
    )
    changed = F.filter(
        F.array(*[F.struct((~F.col(f"new.{f}").eqNullSafe(F.col(f"old.{f}"))).alias("differs"), F.lit(f).alias("field")) for f in fields]),
        lambda x: x["differs"],
    )
    kinds = (
        F.when(F.col("lacks_old") == 1, F.array(F.struct(F.lit("added").alias("change_kind"), F.lit("record").alias("field_name"))))
        .when(F.col("has_new") == 0, F.array(F.struct(F.lit("removed").alias("change_kind"), F.lit("record").alias("field_name"))))
        .otherwise(F.transform(changed, lambda x: F.struct(F.lit("changed").alias("change_kind"), x["field"].alias("field_name"))))
    )
    return matched.select(key, snapshot, F.inline(kinds))


def project_changes(panel: DataFrame, leaves: int = LEAVES, fanout: int = FANOUT) -> DataFrame:
    """(portfolio_id, snapshot_date as text, change_kind, field_name) over the project panel."""
    fields = ["project_name", "dca_ipa", "wlc_baseline_gbp_m", "end_date"]
    found = snapshot_changes(project_snapshots(panel), "portfolio_id", "snapshot_date", fields, leaves, fanout)
    return found.select("portfolio_id", F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "change_kind", "field_name")
