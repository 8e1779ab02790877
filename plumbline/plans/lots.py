"""Queries over lots and bids: a line of an order is a bid, its part the lot, its supplier the bidder."""

from pyspark.sql import functions as F

from ..operators import lots as T
from ..operators.ledger import daily_history
from ..operators.ranks import average_ranks
from ..session import table

ORDER = ["bidder", "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_tax"]


def _bids(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("lot"), F.col("l_suppkey").alias("bidder"), F.col("l_extendedprice").alias("price"), (F.col("l_returnflag") == "R").alias("disqualified"),
        "l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_tax", "l_discount", "l_returnflag", "l_linestatus",
    )


def _lots(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lot"), "p_brand", "p_type", "p_size")
    return T.lot_table(T.live_bids(_bids(spark, sf_dir)), ORDER).join(part, "lot")


def lot_bid_stats(spark, sf_dir):
    return T.lot_statistics(T.live_bids(_bids(spark, sf_dir))).select(
        "lot", "n_bids", "n_bidders", "min_bid", "max_bid", F.round("mean_bid", 4).alias("mean_bid"), F.round("bid_cv", 6).alias("bid_cv"), F.round("bid_spread", 6).alias("bid_spread"), "n_disqualified"
    )


def lot_rank_winner(spark, sf_dir):
    return _lots(spark, sf_dir).select("lot", "winner", "winner_price", "winner_rank", "winner_is_lowest", "lowest_disqualified")


def lowest_disqualified(spark, sf_dir):
    lots = _lots(spark, sf_dir).where("n_bids >= 2 and winner is not null")
    return lots.groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg(F.col("lowest_disqualified").cast("double")), 6).alias("share"))


def pick_contract(spark, sf_dir):
    """Of an order's lines the open ones first, then the latest shipped, then the greatest keys."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    order = F.struct((F.col("l_linestatus") == "O").cast("int"), "l_shipdate", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return T.keep_best(rows, ["l_orderkey"], order).select("l_orderkey", "l_linestatus", "l_partkey", "l_suppkey")


def standardised_difference(spark, sf_dir):
    lots = _lots(spark, sf_dir).withColumn("y", (F.col("bid_cv") > 0.5).cast("int"))
    out = T.standardised_difference(lots, F.coalesce("lowest_disqualified", F.lit(False)), ["p_brand", "p_size"], "y")
    return out.withColumn("difference", F.round("difference", 6))


def decile_table(spark, sf_dir):
    lots = _lots(spark, sf_dir).withColumn("bid_cv", F.round("bid_cv", 6))
    return _rounded(T.decile_table(lots, "bid_cv", ["lowest_disqualified", "winner_is_lowest"]), "middle", "lowest_disqualified_rate", "winner_is_lowest_rate")


def dispersion_table(spark, sf_dir):
    lots = _lots(spark, sf_dir).withColumn("bid_spread", F.round("bid_spread", 6))
    return _rounded(T.decile_table(lots, "bid_spread", ["winner_is_lowest"], 6), "middle", "winner_is_lowest_rate")


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def rate_table(spark, sf_dir):
    return _rounded(T.rate_table(_lots(spark, sf_dir), "p_type", ["lowest_disqualified", "winner_is_lowest"]), "lowest_disqualified_rate", "winner_is_lowest_rate")


def counterfactual_pairs(spark, sf_dir):
    rows = T.counterfactual_rows(T.live_bids(_bids(spark, sf_dir)))
    return rows.groupBy("bidder").agg(
        F.count("*").alias("n_lots"), F.count_if(F.col("price_rank") == 1).alias("n_lowest"), F.round(F.avg("rank_fraction"), 6).alias("mean_rank_fraction")
    )


def transfer_cells(spark, sf_dir):
    """Discount as the forecast, return as the outcome; a lot is won by its cheapest valid bid."""
    live = T.live_bids(_bids(spark, sf_dir)).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("lot"), "p_brand"), "lot")
    won = T.winners(T.live_bids(_bids(spark, sf_dir)), ORDER).select("lot", "winner")
    rows = live.join(won, "lot").select("bidder", "p_brand", (F.col("bidder") == F.col("winner")).alias("won"), (F.col("l_discount") * 10).alias("p"), (F.col("l_linestatus") == "O").cast("int").alias("y"))
    return _rounded(T.transfer_cells(rows, "bidder", "p_brand", "won", "p", "y", 2, 3), "lost_forecast", "won_rate")


def within_lot_percentile(spark, sf_dir):
    """Where the winner's price stands among its lot's bids, averaged by brand; ties share their mean rank."""
    live = T.live_bids(_bids(spark, sf_dir)).select("lot", "price", "bidder")
    ranked = average_ranks(live, ["lot"], "price", "r").groupBy("lot", "price").agg(F.max("r").alias("r"))
    lots = _lots(spark, sf_dir).where("n_bids >= 2").select("lot", "p_brand", F.col("winner_price").alias("price"), "n_bids")
    return lots.join(ranked, ["lot", "price"]).groupBy("p_brand").agg(F.count("*").alias("n"), F.round(F.avg((F.col("r") - 1) / (F.col("n_bids") - 1)), 6).alias("mean_percentile"))


def pair_accuracy(spark, sf_dir):
    """Pairs of orders of one priority and status across customers, at most one size band apart: does the dearer close?"""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("cell"), "o_custkey", "o_totalprice", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).alias("y"), F.floor(F.col("o_totalprice") / 50000).cast("int").alias("band")
    )
    return T.within_cell_pairs(orders, ["cell"], "o_custkey", "o_totalprice", "y", "band", 1).withColumn("accuracy", F.round("accuracy", 6))


def _order_outcomes(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), "o_orderpriority")


def asof_customer_history(spark, sf_dir):
    """Per order: earlier orders of its customer, and the closed rate of those at least 24 months older."""
    orders = _order_outcomes(spark, sf_dir)
    history = daily_history(orders, "o_custkey", "day", F.add_months("day", 24), {"y": F.col("y")})
    return orders.join(history, ["o_custkey", "day"], "left").select("o_orderkey", "n_before", "y_n", "y_mean")


def asof_two_entities(spark, sf_dir):
    orders = _order_outcomes(spark, sf_dir)
    nation = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    rows = orders.join(nation, "o_custkey")
    a = daily_history(rows, "o_custkey", "day", F.add_months("day", 12), {"y": F.col("y")}).select("o_custkey", "day", F.col("n_before").alias("n_customer"), F.col("y_mean").alias("customer_rate"))
    b = daily_history(rows, "c_nationkey", "day", F.add_months("day", 12), {"y": F.col("y")}).select("c_nationkey", "day", F.col("n_before").alias("n_nation"), F.col("y_mean").alias("nation_rate"))
    return rows.join(a, ["o_custkey", "day"], "left").join(b, ["c_nationkey", "day"], "left").select("o_orderkey", "n_customer", "customer_rate", "n_nation", "nation_rate")


def asof_global_rate(spark, sf_dir):
    """Over all orders: how many came before each day, and their closed rate, by totals per day."""
    orders = _order_outcomes(spark, sf_dir).withColumn("everything", F.lit("all"))
    return daily_history(orders, "everything", "day", F.col("day"), {"y": F.col("y")}).select("day", "n_before", "y_mean")


def asof_frozen_cutoff(spark, sf_dir):
    """Histories frozen at one day: what each customer had by 1999-01-01."""
    rows = _order_outcomes(spark, sf_dir).where("day < date'1999-01-01'")
    return rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("y"), 9).alias("rate"))


def asof_holder_in_vehicle(spark, sf_dir):
    """Three levels: customer within priority, customer, priority."""
    orders = _order_outcomes(spark, sf_dir).withColumn("both", F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority"))
    out = orders
    for name, key in (("both", "both"), ("customer", "o_custkey"), ("priority", "o_orderpriority")):
        h = daily_history(orders, key, "day", F.col("day"), {"y": F.col("y")}).select(key, "day", F.col("n_before").alias(f"n_{name}"))
        out = out.join(h, [key, "day"], "left")
    return out.select("o_orderkey", "n_both", "n_customer", "n_priority")


QUERIES = {
    f.__name__: f
    for f in (
        lot_bid_stats, lot_rank_winner, lowest_disqualified, pick_contract, standardised_difference, decile_table, dispersion_table, rate_table,
        counterfactual_pairs, transfer_cells, within_lot_percentile, pair_accuracy, asof_customer_history, asof_two_entities, asof_global_rate,
        asof_frozen_cutoff, asof_holder_in_vehicle,
    )
}

_B = "b as (select l_partkey as lot, l_suppkey as bidder, l_extendedprice as price, l_returnflag = 'R' as disq, *, rank() over (partition by l_partkey order by l_extendedprice) as rk from lineitem)"
_S = (
    _B
    + """, st as (select lot, count(*) as n_bids, count(distinct bidder) as n_bidders, min(price) as min_bid, max(price) as max_bid, cast(sum(cast(price as decimal(18,2))) as double) / count(*) as mean_bid,
      stddev_samp(price) as std_bid, count_if(disq) as n_disqualified, stddev_samp(price) / (cast(sum(cast(price as decimal(18,2))) as double) / count(*)) as bid_cv, max(price) / min(price) - 1 as bid_spread from b group by 1),
    wi as (select lot, bidder as winner, price as winner_price, rk as winner_rank from b where not disq qualify row_number() over (partition by lot order by price, bidder, l_orderkey, l_linenumber, l_shipdate, l_quantity, l_tax) = 1),
    lo as (select lot, bool_or(disq) as lowest_disqualified from b where rk = 1 group by 1),
    lots as (select st.*, winner, winner_price, winner_rank, coalesce(winner_rank = 1, false) as winner_is_lowest, lowest_disqualified, p_brand, p_type, p_size
      from st left join wi using (lot) left join lo using (lot) join part on p_partkey = lot)"""
)


def _deciles(value, bins, labels):
    rates = ", ".join(f"round(avg(cast({c} as double)), 6) as {c}_rate" for c in labels)
    shares = ", ".join(str(i / bins) for i in range(bins + 1))
    return f"""with {_S}, v as (select *, round({value}, 6) as v from lots where {value} is not null), e as (select list_sort(list_distinct(quantile_cont(v, [{shares}]))) as edges from v)
      select cast(greatest(0, len(list_filter(edges, lambda x: x < v)) - 1) as int) as bin, count(*) as n, min(v) as low, round(median(v), 6) as middle, max(v) as high, {rates} from v, e group by 1"""


_O = "o as (select o_orderkey, o_custkey, cast(o_orderdate as date) as day, cast(o_orderstatus = 'F' as int) as y, o_orderpriority from orders)"


def _asof(key, months):
    return f"""(select q.o_orderkey, (select count(*) from o e where e.{key} = q.{key} and e.day < q.day) as n, (select count(*) from o e where e.{key} = q.{key} and cast(e.day + to_months({months}) as date) <= q.day) as yn,
      (select round(avg(e.y), 9) from o e where e.{key} = q.{key} and cast(e.day + to_months({months}) as date) <= q.day) as m from o q)"""


SQL = {
    "lot_bid_stats": f"with {_S} select lot, n_bids, n_bidders, min_bid, max_bid, round(mean_bid, 4) as mean_bid, round(bid_cv, 6) as bid_cv, round(bid_spread, 6) as bid_spread, n_disqualified from st",
    "lot_rank_winner": f"with {_S} select lot, winner, winner_price, cast(winner_rank as int) as winner_rank, winner_is_lowest, lowest_disqualified from lots",
    "lowest_disqualified": f"with {_S} select p_brand, count(*) as n, round(avg(cast(lowest_disqualified as double)), 6) as share from lots where n_bids >= 2 and winner is not null group by 1",
    "pick_contract": "select l_orderkey, l_linestatus, l_partkey, l_suppkey from lineitem qualify row_number() over (partition by l_orderkey order by l_linestatus = 'O' desc, l_shipdate desc, l_partkey desc, l_suppkey desc, l_linenumber desc, l_extendedprice desc) = 1",
    "standardised_difference": f"""with {_S}, c as (select p_brand, p_size, count(*) filter (coalesce(lowest_disqualified, false)) as nt, count(*) filter (not coalesce(lowest_disqualified, false)) as nc,
        avg(cast(bid_cv > 0.5 as double)) filter (coalesce(lowest_disqualified, false)) as yt, avg(cast(bid_cv > 0.5 as double)) filter (not coalesce(lowest_disqualified, false)) as yc from lots where bid_cv is not null group by 1, 2)
      select count(*) as n_cells, cast(sum(nt) as bigint) as n_treated, cast(sum(nc) as bigint) as n_control, round(sum(nt * (yt - yc)) / sum(nt), 6) as difference from c where nt > 0 and nc > 0""",
    "decile_table": _deciles("bid_cv", 10, ("lowest_disqualified", "winner_is_lowest")),
    "dispersion_table": _deciles("bid_spread", 6, ("winner_is_lowest",)),
    "rate_table": f"with {_S} select p_type, count(*) as n, round(avg(cast(lowest_disqualified as double)), 6) as lowest_disqualified_rate, round(avg(cast(winner_is_lowest as double)), 6) as winner_is_lowest_rate from lots group by 1",
    "counterfactual_pairs": f"""with {_B}, c as (select lot, bidder, min(price) as price from b group by 1, 2), r as (select *, rank() over w as pr, percent_rank() over w as rf from c window w as (partition by lot order by price))
      select bidder, count(*) as n_lots, count_if(pr = 1) as n_lowest, round(avg(rf), 6) as mean_rank_fraction from r group by 1""",
    "transfer_cells": f"""with {_S}, r as (select b.bidder, p.p_brand, b.bidder = w.winner as won, l_discount * 10 as f, cast(l_linestatus = 'O' as double) as y from b join part p on p.p_partkey = b.lot join wi w on w.lot = b.lot)
      select bidder, p_brand, count_if(won) as n_won, count_if(not won) as n_lost, round(avg(f) filter (not won), 6) as lost_forecast, round(avg(y) filter (won), 6) as won_rate from r group by 1, 2 having count_if(won) >= 2 and count_if(not won) >= 3""",
    "within_lot_percentile": f"""with {_S}, r as (select lot, price, max(rk) + (count(*) - 1) / 2.0 as r from b group by 1, 2)
      select p_brand, count(*) as n, round(avg(cast(r - 1 as double) / (n_bids - 1)), 6) as mean_percentile from lots l join r on r.lot = l.lot and r.price = l.winner_price where n_bids >= 2 group by 1""",
    "pair_accuracy": """with o as (select o_orderpriority as cell, o_custkey, o_totalprice as s, o_orderstatus as st, cast(floor(o_totalprice / 50000) as int) as b from orders where o_orderstatus in ('F', 'O'))
      select count(*) as n_pairs, cast(sum(case when x.s > z.s then 1 when x.s = z.s then 0.5 else 0 end) as double) as n_right, round(avg(case when x.s > z.s then 1 when x.s = z.s then 0.5 else 0 end), 6) as accuracy
      from o x join o z on x.cell = z.cell and x.o_custkey <> z.o_custkey and x.st = 'F' and z.st = 'O' and abs(x.b - z.b) <= 1""",
    "asof_customer_history": f"with {_O} select o_orderkey, n as n_before, yn as y_n, m as y_mean from {_asof('o_custkey', 24)}",
    "asof_two_entities": f"""with {_O.replace('o as (select', 'o as (select c_nationkey,').replace('from orders', 'from orders join customer on c_custkey = o_custkey')}
      select c.o_orderkey, c.n as n_customer, c.m as customer_rate, n.n as n_nation, n.m as nation_rate from {_asof('o_custkey', 12)} c join {_asof('c_nationkey', 12)} n using (o_orderkey)""",
    "asof_global_rate": f"""with {_O}, d as (select day, count(*) as n, sum(y) as s from o group by 1)
      select day, cast(sum(n) over w - n as bigint) as n_before, round(sum(s) over w / sum(n) over w, 9) as y_mean from d window w as (order by day rows unbounded preceding)""",
    "asof_frozen_cutoff": f"with {_O} select o_custkey, count(*) as n, round(avg(y), 9) as rate from o where day < date '1999-01-01' group by 1",
    "asof_holder_in_vehicle": f"""with {_O} select q.o_orderkey, (select count(*) from o e where e.o_custkey = q.o_custkey and e.o_orderpriority = q.o_orderpriority and e.day < q.day) as n_both,
      (select count(*) from o e where e.o_custkey = q.o_custkey and e.day < q.day) as n_customer, (select count(*) from o e where e.o_orderpriority = q.o_orderpriority and e.day < q.day) as n_priority from o q""",
}
