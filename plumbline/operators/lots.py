"""Lots and bids: ranks, statistics, winners, contrasts between cells, transfer of forecasts.

``bids`` has lot, bidder, price, disqualified and an order key; every ranking is within a lot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import competition_ranks, exact_quantiles, running_totals, same_keys
from .scoring import equal_count_bin, equal_count_edges


def live_bids(bids: DataFrame) -> DataFrame:
    """Priced bids with their competition rank by price in the lot."""
    return competition_ranks(bids.where("price is not null and lot is not null"), ["lot"], "price", "rank_in_lot")


def lot_statistics(live: DataFrame) -> DataFrame:
    price = F.col("price").cast("decimal(18,2)")
    return live.groupBy("lot").agg(
        F.count("*").alias("n_bids"),
        F.count_distinct("bidder").alias("n_bidders"),
        F.min("price").alias("min_bid"),
        F.max("price").alias("max_bid"),
        (F.sum(price).cast("double") / F.count("*")).alias("mean_bid"),
        F.stddev_samp("price").alias("std_bid"),
        F.count_if("disqualified").alias("n_disqualified"),
    ).select(
        "*",
        F.when(F.col("mean_bid") > 0, F.col("std_bid") / F.col("mean_bid")).alias("bid_cv"),
        F.when(F.col("min_bid") > 0, F.col("max_bid") / F.col("min_bid") - 1).alias("bid_spread"),
    )


def winners(live: DataFrame, order: list[str]) -> DataFrame:
    """The cheapest bid that was not disqualified, by a partial minimum; ties by ``order``."""
    return live.where(~F.coalesce("disqualified", F.lit(False))).groupBy("lot").agg(
        F.min_by(F.struct("bidder", "price", "rank_in_lot"), F.struct("price", *order)).alias("w")
    ).select("lot", F.col("w.bidder").alias("winner"), F.col("w.price").alias("winner_price"), F.col("w.rank_in_lot").alias("winner_rank"))


def lot_table(live: DataFrame, order: list[str]) -> DataFrame:
    """One row per lot: statistics, winner, and whether the lowest bid was disqualified."""
    lowest = live.where("rank_in_lot = 1").groupBy("lot").agg(F.bool_or("disqualified").alias("lowest_disqualified"))
    joined = lot_statistics(live).join(winners(live, order), "lot", "left").join(lowest, "lot", "left")
    return joined.withColumn("winner_is_lowest", F.coalesce(F.col("winner_rank") == 1, F.lit(False)))


def rate_table(rows: DataFrame, by: str, labels: list[str]) -> DataFrame:
    """n and the mean of every label per level; null is a level of its own."""
    return rows.groupBy(by).agg(F.count("*").alias("n"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in labels])


def decile_table(rows: DataFrame, value: str, labels: list[str], bins: int = 10) -> DataFrame:
    """Equal-count bins with repeated edges dropped: extremes, median and rates."""
    one = rows.where(F.col(value).isNotNull()).withColumn("__all", F.lit(1))
    edges = equal_count_edges(one, ["__all"], value, bins)
    # the edges are a single row
    binned = one.join(F.broadcast(edges), "__all").withColumn("bin", equal_count_bin(F.col(value), F.col("edges"))).drop("edges", "__all")
    middle = exact_quantiles(binned, ["bin"], value, [0.5], "q").select("bin", F.col("q")[0].alias("middle"))
    found = binned.groupBy("bin").agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), *[F.avg(F.col(c).cast("double")).alias(f"{c}_rate") for c in labels]
    )
    return found.join(middle, "bin").select("bin", "n", "low", "middle", "high", *[f"{c}_rate" for c in labels])


def standardised_difference(rows: DataFrame, treated: Column, cells: list[str], label: str) -> DataFrame:
    """Treated minus control rate over the cells that have both, weighted by treated rows."""
    sides = rows.where(F.col(label).isNotNull()).groupBy(*cells).agg(
        F.count_if(treated).alias("nt"), F.count_if(~treated).alias("nc"),
        F.avg(F.when(treated, F.col(label).cast("double"))).alias("yt"), F.avg(F.when(~treated, F.col(label).cast("double"))).alias("yc"),
    )
    both = sides.where("nt > 0 and nc > 0")
    return both.agg(
        F.count("*").alias("n_cells"), F.sum("nt").alias("n_treated"), F.sum("nc").alias("n_control"),
        (F.sum(F.col("nt") * (F.col("yt") - F.col("yc"))) / F.sum("nt")).alias("difference"),
    )


def keep_best(rows: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The row of greatest ``order`` per key, by a partial maximum."""
    columns = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*columns), order).alias("r")).select(*key, "r.*")


def within_cell_pairs(rows: DataFrame, cell: list[str], ident: str, signal: str, y: str, band: str, gap: int) -> DataFrame:
    """(n_pairs, right) over pairs of a cell with different outcomes, different keys and bands at most ``gap`` apart.

    A pair is right when the higher signal has the outcome; ties count half.  Pairs are never formed: rows
    are counted per (cell, key, band, signal), rows without the outcome once for every band within the gap, and running
    totals give the number of signals below.
    """
    data = rows.where(F.col(y).isNotNull() & F.col(signal).isNotNull())
    positive = data.where(F.col(y) == 1).select(*cell, F.col(ident).alias("k"), F.col(band).alias("b"), F.col(signal).alias("s"), F.lit(1).alias("pos"), F.lit(0).alias("neg"))
    negative = data.where(F.col(y) == 0).select(
        *cell, F.col(ident).alias("k"), F.explode(F.sequence(F.col(band) - gap, F.col(band) + gap)).alias("b"), F.col(signal).alias("s"), F.lit(0).alias("pos"), F.lit(1).alias("neg")
    )
    both = positive.unionByName(negative)

    by = [*cell, "b", "own", "k2"]
    # every signal counts once among all of its cell and band, and once among those of its key only
    key = F.col("k").cast("string")
    kinds = F.array(F.struct(F.lit(False).alias("own"), F.lit(None).cast("string").alias("k2")), F.struct(F.lit(True).alias("own"), key.alias("k2")))
    each = both.select("*", F.inline(kinds))
    counts = each.groupBy(*by, "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    u = running_totals(counts, by, "s", {"below": "neg"}).groupBy(*by).agg(
        F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u")
    )
    sign = F.when(F.col("own"), -1).otherwise(1)
    totals = u.agg(F.coalesce(F.sum(sign * F.col("p") * F.col("q")), F.lit(0)).cast("bigint").alias("n_pairs"), F.coalesce(F.sum(sign * F.col("u")), F.lit(0.0)).cast("double").alias("n_right"))
    return totals.withColumn("accuracy", F.try_divide("n_right", "n_pairs"))


def counterfactual_rows(live: DataFrame) -> DataFrame:
    """One row per lot and bidder with its best price, the price rank that this gives and who won."""
    best = live.groupBy("lot", "bidder").agg(F.min("price").alias("price"), F.bool_and("disqualified").alias("disqualified"))
    sizes = best.groupBy("lot").agg(F.count("*").alias("__size"))
    ranked = same_keys(competition_ranks(best, ["lot"], "price", "price_rank"), sizes, ["lot"])
    fraction = F.coalesce(F.try_divide(F.col("price_rank") - 1, F.col("__size") - 1), F.lit(0.0))
    return ranked.withColumn("rank_fraction", fraction).drop("__size")


def transfer_cells(rows: DataFrame, bidder: str, division: str, won: str, forecast: str, y: str, least_won: int, least_lost: int) -> DataFrame:
    """Per bidder and division: mean forecast of lots it lost, and the realised rate of those it won."""
    return (
        rows.groupBy(bidder, division)
        .agg(
            F.count_if(won).alias("n_won"), F.count_if(~F.col(won)).alias("n_lost"),
            F.avg(F.when(~F.col(won), F.col(forecast))).alias("lost_forecast"), F.avg(F.when(F.col(won), F.col(y).cast("double"))).alias("won_rate"),
        )
        .where((F.col("n_won") >= least_won) & (F.col("n_lost") >= least_lost))
    )
