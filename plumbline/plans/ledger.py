"""Queries of the award ledger: actions, base rows, horizons, labels, histories, panel and field evidence."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..operators import ledger as L
from ..operators.ranks import exact_quantiles
from ..session import table
from ..sources.readers import years_counted, years_missing

KEY = L.KEY


def _ledger(spark, sf_dir):
    return table(spark, sf_dir, "action_ledger")


def _actions(spark, sf_dir):
    return L.load_actions(_ledger(spark, sf_dir))


def ledger_scan_typed(spark, sf_dir):
    return _actions(spark, sf_dir).groupBy(F.col("source_fiscal_year").alias("fy"), "is_base_mod").agg(
        F.count("*").alias("n_actions"),
        F.count_distinct(KEY).alias("n_awards"),
        F.min("action_date").alias("first_date"),
        F.max("action_date").alias("last_date"),
        F.sum("mod_seq").alias("sum_mod_seq"),
        F.sum("txn_seq").alias("sum_txn_seq"),
    )


def order_ledger_scan(spark, sf_dir):
    """The same for delivery orders: the other award type."""
    rows = L.load_actions(_ledger(spark, sf_dir), "C")
    return rows.groupBy(E.fiscal_year(F.col("action_date")).alias("fy")).agg(F.count("*").alias("n_actions"), F.count_distinct(KEY).alias("n_orders"))


def year_gaps(spark, sf_dir):
    """Fiscal years between the ledger's first and last source year that have no action."""
    return years_missing(_ledger(spark, sf_dir), "source_fiscal_year").select(F.col("year").alias("fy"))


def years_present(spark, sf_dir):
    """Every year between the ledger's first and last source year with its actions, and whether it is a gap."""
    return years_counted(_ledger(spark, sf_dir), "source_fiscal_year").select(F.col("year").alias("fy"), F.col("n").alias("n_actions"), (F.col("n") == 0).alias("is_gap"))


def action_type_counts(spark, sf_dir):
    rows = _ledger(spark, sf_dir).dropDuplicates(["action_id"])
    return rows.groupBy("award_type_code", "action_type_code").agg(F.count("*").alias("n"), F.count_distinct(KEY).alias("n_awards"))


def archive_recount(spark, sf_dir):
    rows = _ledger(spark, sf_dir)
    return rows.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("award_type_code") == "D").alias("n_type_d"),
        F.count_distinct(F.when(F.col("award_type_code") == "D", F.col(KEY))).alias("n_awards_d"),
        (F.count("*") - F.count_distinct("action_id")).alias("n_redelivered"),
    )


def award_base_row(spark, sf_dir):
    base = L.base_rows(_actions(spark, sf_dir))
    return base.select(KEY, "action_id", "action_date", "first_action_date", "n_base_rows", "n_actions", "base_is_first_action", "base_fy")


def horizon_state_12_24_36(spark, sf_dir):
    actions = _actions(spark, sf_dir)
    states = L.states_at_horizons(actions, L.identified(L.base_rows(actions)))
    each = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.col(f"current_end_at_{h}").alias("current_end"),
                F.col(f"last_action_date_by_{h}").alias("last_action_date"),
                F.col(f"n_actions_by_{h}").alias("n_actions"),
                F.col(f"ceiling_delta_by_{h}").cast("double").alias("ceiling_delta"),
                F.col(f"exercised_delta_by_{h}").cast("double").alias("exercised_delta"),
                F.col(f"obligated_by_{h}").cast("double").alias("obligated"),
                F.col(f"terminated_{h}").alias("terminated"),
                F.col(f"change_order_count_{h}").alias("change_orders"),
                F.col(f"change_order_value_{h}").cast("double").alias("change_order_value"),
                F.col(f"option_exercise_count_{h}").alias("options"),
            )
            for h in E.HORIZONS
        ]
    )
    return states.select(KEY, F.inline(each))


def _long_labels(labels, *carried):
    each = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.col(f"qualifies_{h}").alias("qualifies"),
                F.col(f"ceiling_growth_{h}").alias("growth"),
                F.col(f"ceiling_growth_gt10_{h}").alias("gt10"),
                F.col(f"ceiling_growth_gt25_{h}").alias("gt25"),
                F.col(f"ceiling_growth_gt50_{h}").alias("gt50"),
                F.col(f"schedule_slip_days_{h}").alias("slip_days"),
                F.col(f"schedule_slip_gt90_{h}").alias("slip90"),
                F.col(f"schedule_slip_gt365_{h}").alias("slip365"),
                F.col(f"award_level_gt25_{h}").alias("award_level_gt25"),
                F.col(f"any_change_order_{h}").alias("any_change_order"),
                F.col(f"terminated_{h}").alias("terminated"),
            )
            for h in E.HORIZONS
        ]
    )
    return labels.select(*carried, F.inline(each))


def award_labels(spark, sf_dir):
    return _long_labels(L.award_labels(_ledger(spark, sf_dir)), KEY)


def funnel(spark, sf_dir):
    """Awards left after every filter, in order."""
    base = L.base_rows(_actions(spark, sf_dir))
    steps = [("start", F.lit(True))]
    for name, cond in (
        ("explicit base modification", F.col("has_explicit_base")),
        ("base is first action", F.col("base_is_first_action")),
        ("years covered", F.col("base_fy").between(L.FIRST_YEAR, L.LAST_YEAR)),
        ("single base row", F.col("has_single_base_row")),
        ("obligation at threshold", F.col("federal_action_obligation") >= L.THRESHOLD),
        ("end date known", F.col("period_of_performance_current_end_date").isNotNull()),
        ("ceiling positive", F.col("base_and_all_options_value") > 0),
    ):
        steps.append((name, steps[-1][1] & F.coalesce(cond, F.lit(False))))
    counts = base.agg(*[F.count_if(c).alias(f"n{i}") for i, (_, c) in enumerate(steps)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("filter"), F.col(f"n{i}").alias("n")) for i, (n, _) in enumerate(steps)])))


def award_history(spark, sf_dir):
    labels = L.add_history(L.award_labels(_ledger(spark, sf_dir)))
    return labels.select(
        KEY, *[f"{e}_{c}" for e in ("recipient", "office") for c in ("prior_award_count", "prior_mean_growth", "prior_termination_rate", "prior_slip_rate")]
    )


def award_panel(spark, sf_dir):
    panel = L.award_panel(_ledger(spark, sf_dir))
    return panel.select(
        KEY, "base_fy", "naics2", "psc1", F.round("log_base_obligation", 6).alias("log_base_obligation"), F.round("log_base_ceiling", 6).alias("log_base_ceiling"),
        F.round("option_heaviness", 6).alias("option_heaviness"), "planned_duration_days", "potential_extra_duration_days", "n_offers_missing", "base_month",
        "base_is_september", "ceiling_growth_36", "recipient_prior_award_count", "office_prior_slip_rate",
    )


def base_rates_rollup(spark, sf_dir):
    """Rate of every label by horizon and base year, with a total row per label and horizon."""
    rows = _long_labels(L.award_labels(_ledger(spark, sf_dir)), "base_fy").where("qualifies")
    each = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("double").alias("y")) for c in ("gt10", "gt25", "gt50", "slip90", "slip365", "any_change_order", "terminated")])
    return (
        rows.select("base_fy", "horizon", F.inline(each))
        .groupingSets([["label", "horizon", "base_fy"], ["label", "horizon"]], "label", "horizon", "base_fy")
        .agg(F.count("y").alias("n"), F.round(F.avg("y"), 9).alias("rate"))
        .select("label", "horizon", F.coalesce(F.col("base_fy").cast("string"), F.lit("ALL")).alias("fy"), "n", "rate")
    )


def leak_comparison(spark, sf_dir):
    rows = _long_labels(L.award_labels(_ledger(spark, sf_dir))).where("qualifies")
    both = F.col("gt25").isNotNull() & F.col("award_level_gt25").isNotNull()
    return rows.groupBy("horizon").agg(
        F.count_if(both).alias("n_both"),
        F.round(F.avg(F.when(both, F.col("gt25"))), 9).alias("rate_reconstructed"),
        F.round(F.avg(F.when(both, F.col("award_level_gt25"))), 9).alias("rate_award_level"),
        F.round(F.avg(F.when(both, (F.col("gt25") == F.col("award_level_gt25")).cast("double"))), 9).alias("agreement"),
    )


def continuous_summary(spark, sf_dir):
    rows = _long_labels(L.award_labels(_ledger(spark, sf_dir))).where("qualifies and growth is not null")
    names = ("p01", "p25", "p50", "p75", "p90", "p99")
    q = exact_quantiles(rows, ["horizon"], "growth", [0.01, 0.25, 0.5, 0.75, 0.9, 0.99], "q")
    out = rows.groupBy("horizon").agg(
        F.count("*").alias("n"),
        F.round(F.avg(F.col("growth").cast("decimal(24,10)")).cast("double"), 8).alias("mean"),
        F.round(F.stddev_samp("growth"), 6).alias("sd"),
        F.round(F.avg((F.col("growth") == 0).cast("double")), 9).alias("share_zero"),
    )
    return out.join(q, "horizon").select("*", *[F.round(F.col("q")[i], 8).alias(n) for i, n in enumerate(names)]).drop("q")


def running_reconstruction(spark, sf_dir):
    """Per award: the ceiling rebuilt from level and changes, against the last stated total."""
    rows = _actions(spark, sf_dir)
    past = Window.partitionBy(KEY).orderBy("action_date", "mod_seq", "txn_seq", "mod_str", "action_id").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.withColumn("rebuilt", F.sum(L.money(F.col("base_and_all_options_value"))).over(past))
    stated = F.col("potential_total_value_of_award")
    return (
        running.where(stated.isNotNull() & F.col("rebuilt").isNotNull())
        .withColumn("agrees", E.close(F.col("rebuilt").cast("double"), stated))
        .groupBy(E.fiscal_year(F.col("action_date")).alias("fy"))
        .agg(F.count("*").alias("n"), F.round(F.avg(F.col("agrees").cast("double")), 9).alias("share_agreeing"))
    )


def restatement_share(spark, sf_dir):
    """Of actions that are not an award's last: how many already state the final total."""
    rows = _actions(spark, sf_dir)
    last = Window.partitionBy(KEY).orderBy(F.desc("action_date"), F.desc("mod_seq"), F.desc("txn_seq"), F.desc("mod_str"), F.desc("action_id"))
    ranked = rows.withColumn("from_end", F.row_number().over(last)).withColumn("final", F.first("potential_total_value_of_award").over(last))
    block = ranked.where("from_end > 1 and final is not null and potential_total_value_of_award is not null")
    return block.groupBy(E.fiscal_year(F.col("action_date")).alias("fy")).agg(
        F.count("*").alias("n"),
        F.round(F.avg(E.close(F.col("potential_total_value_of_award"), F.col("final")).cast("double")), 9).alias("share_final"),
    )


def last_nonfinal(spark, sf_dir):
    """Lag of the running obligation: how many steps never go down, by award type code of the action."""
    rows = _actions(spark, sf_dir)
    order = Window.partitionBy(KEY).orderBy("action_date", "mod_seq", "txn_seq", "mod_str", "action_id")
    total = F.sum(L.money(F.col("federal_action_obligation"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    stepped = rows.withColumn("total", total).withColumn("before", F.lag("total").over(order)).where("before is not null and total is not null")
    return stepped.groupBy("action_type_code").agg(F.count("*").alias("n"), F.round(F.avg((F.col("total") >= F.col("before")).cast("double")), 9).alias("share_not_down"))


def fill_rates(spark, sf_dir):
    base = L.identified(L.base_rows(_actions(spark, sf_dir)))
    fields = ("number_of_offers_received", "extent_competed_code", "type_of_contract_pricing_code", "recipient_uei", "base_and_all_options_value")
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().cast("double").alias("filled")) for f in fields])
    return base.select("base_fy", F.inline(each)).groupBy("base_fy", "field").agg(F.count("*").alias("n"), F.round(F.avg("filled"), 9).alias("share_filled"))


def name_fragmentation(spark, sf_dir):
    """The eight names with most identifiers, and the share of awards under the largest of them."""
    base = L.base_rows(_actions(spark, sf_dir)).where("recipient_name is not null and recipient_uei is not null")
    by_id = base.groupBy("recipient_name", "recipient_uei").agg(F.count("*").alias("n"))
    return (
        by_id.groupBy("recipient_name")
        .agg(F.count("*").alias("n_ids"), F.sum("n").alias("n_awards"), F.round(F.max("n") / F.sum("n"), 9).alias("largest_share"))
        .orderBy(F.desc("n_ids"), F.desc("n_awards"), "recipient_name")
        .limit(8)
    )


def placeholder_recipients(spark, sf_dir):
    base = L.base_rows(_actions(spark, sf_dir))
    return base.groupBy(E.is_aggregate_recipient(F.col("recipient_name")).alias("is_placeholder"), F.col("recipient_uei").isNull().alias("no_id")).agg(F.count("*").alias("n_awards"))


def censoring_rollup(spark, sf_dir):
    """Awards whose horizon has closed, by base year, with a total."""
    labels = L.award_labels(_ledger(spark, sf_dir))
    counts = labels.rollup("base_fy").agg(*[F.count_if(f"qualifies_{h}").alias(f"n_{h}") for h in E.HORIZONS], F.count("*").alias("n"))
    return counts.select(F.coalesce(F.col("base_fy").cast("string"), F.lit("ALL")).alias("fy"), "n_12", "n_24", "n_36", "n")


def unseen_entity_slice(spark, sf_dir):
    """Test awards by whether their recipient appears in a training year; placeholders are left out on both sides."""
    base = L.identified(L.base_rows(_actions(spark, sf_dir))).withColumn("split", E.split_of(F.col("base_fy")))
    usable = base.where(F.col("recipient_uei").isNotNull() & ~E.is_aggregate_recipient(F.col("recipient_name")))
    seen = usable.where("split = 'train'").select("recipient_uei").distinct()
    test = usable.where("split = 'test'")
    unseen = test.join(seen, "recipient_uei", "left_anti").agg(F.count("*").alias("n")).select(F.lit("unseen").alias("slice"), "n")
    return unseen.unionByName(test.join(seen, "recipient_uei", "left_semi").agg(F.count("*").alias("n")).select(F.lit("seen").alias("slice"), "n"))


def splits_by_year(spark, sf_dir):
    base = L.identified(L.base_rows(_actions(spark, sf_dir)))
    return base.groupBy(E.split_of(F.col("base_fy")).alias("split")).agg(F.count("*").alias("n"), F.min("base_fy").alias("first_fy"), F.max("base_fy").alias("last_fy"))


def top_codes(spark, sf_dir):
    rows = _actions(spark, sf_dir).where("product_or_service_code is not null")
    return rows.groupBy("product_or_service_code").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "product_or_service_code").limit(20)


def offer_bands(spark, sf_dir):
    base = L.identified(L.base_rows(_actions(spark, sf_dir)))
    return base.groupBy(E.offer_band(F.col("number_of_offers_received")).alias("band")).agg(
        F.count("*").alias("n"), F.round(F.avg(L.money(F.col("federal_action_obligation"))).cast("double"), 4).alias("mean_obligation")
    )


def vehicle_programs(spark, sf_dir):
    """Vehicles as sibling sets: agency and solicitation shared by at least two awards and two recipients, else alone."""
    base = L.base_rows(_actions(spark, sf_dir)).withColumn("agency", E.agency_of_key(F.col(KEY)))
    vehicle = table(spark, sf_dir, "action_ledger").where("vehicle is not null").groupBy(KEY).agg(F.min(E.normalised_solicitation(F.col("vehicle"))).alias("sol"))
    rows = base.join(vehicle, KEY).select(KEY, "agency", "sol", "recipient_uei")
    sets = rows.groupBy("agency", "sol").agg(F.count("*").alias("n_awards"), F.count_distinct("recipient_uei").alias("n_recipients"))
    joined = rows.join(sets, ["agency", "sol"])
    program = F.when((F.col("n_awards") >= 2) & (F.col("n_recipients") >= 2), F.concat_ws("|", "agency", "sol")).otherwise(F.col(KEY))
    return joined.groupBy(program.alias("program")).agg(F.count("*").alias("n_members"))


def modal_value(spark, sf_dir):
    """Modal pricing code and first known competition code per vehicle; ties go to the least code."""
    rows = table(spark, sf_dir, "action_ledger").dropDuplicates(["action_id"]).where("vehicle is not null")
    counts = rows.where("type_of_contract_pricing_code is not null").groupBy("vehicle", "type_of_contract_pricing_code").agg(F.count("*").alias("n"))
    modal = counts.groupBy("vehicle").agg(F.min_by("type_of_contract_pricing_code", F.struct(-F.col("n"), F.col("type_of_contract_pricing_code"))).alias("modal_pricing"))
    first = rows.groupBy("vehicle").agg(
        F.min_by("extent_competed_code", F.when(F.col("extent_competed_code").isNotNull(), F.struct("action_date", "action_id"))).alias("first_competed"),
        F.min("action_date").alias("first_date"),
        F.count("*").alias("n_actions"),
    )
    return first.join(modal, "vehicle", "left")


def vehicle_holders_all_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "action_ledger").dropDuplicates(["action_id"]).where("vehicle is not null")
    return rows.groupBy("vehicle", "recipient_uei", E.fiscal_year(F.col("action_date")).alias("fy")).agg(F.count("*").alias("n_actions"), F.count_distinct(KEY).alias("n_awards"))


def order_keep_set(spark, sf_dir):
    """Orders kept: a base row of at least the threshold in this or an earlier year; then all their actions from then on."""
    rows = L.load_actions(_ledger(spark, sf_dir), "C").withColumn("fy", E.fiscal_year(F.col("action_date")))
    keep = rows.where(F.col("is_base_mod") & (F.col("federal_action_obligation") >= L.THRESHOLD)).groupBy(KEY).agg(F.min("fy").alias("since"))
    return rows.join(keep, KEY).where("fy >= since").groupBy("fy").agg(F.count("*").alias("n_actions"), F.count_distinct(KEY).alias("n_orders"))


def eligible_having(spark, sf_dir):
    """Vehicles with enough awards and holders in training years and enough awards in test years."""
    base = L.identified(L.base_rows(_actions(spark, sf_dir))).withColumn("split", E.split_of(F.col("base_fy"))).where("recipient_uei is not null")
    vehicle = table(spark, sf_dir, "action_ledger").where("vehicle is not null").groupBy(KEY).agg(F.min("vehicle").alias("vehicle"))
    train, test = F.col("split") == "train", F.col("split") == "test"
    return (
        base.join(vehicle, KEY)
        .groupBy("awarding_office_code")
        .agg(F.count_if(train).alias("n_train"), F.count_distinct(F.when(train, F.col("recipient_uei"))).alias("n_holders"), F.count_if(test).alias("n_test"))
        .where("n_train >= 5 and n_holders >= 3 and n_test >= 2")
    )


def relative_size_loo(spark, sf_dir):
    """An award's log obligation against the mean of the others of its cell; cells of at least five."""
    base = L.base_features(L.award_labels(_ledger(spark, sf_dir)))
    x = F.round("log_base_obligation", 8).cast("decimal(20,8)")
    cell = Window.partitionBy("awarding_agency_code", "psc1", "base_fy")
    rows = base.where("awarding_agency_code is not null and psc1 is not null").withColumn("x", x).withColumn("n", F.count("x").over(cell)).withColumn("s", F.sum("x").over(cell))
    return rows.where("n >= 5 and x is not null").select(KEY, F.round(F.col("x").cast("double") - (F.col("s") - F.col("x")).cast("double") / (F.col("n") - 1), 7).alias("relative_size"))


QUERIES = {
    f.__name__: f
    for f in (
        ledger_scan_typed, order_ledger_scan, year_gaps, years_present, action_type_counts, archive_recount, award_base_row, horizon_state_12_24_36, award_labels, funnel,
        award_history, award_panel, base_rates_rollup, leak_comparison, continuous_summary, running_reconstruction, restatement_share, last_nonfinal,
        fill_rates, name_fragmentation, placeholder_recipients, censoring_rollup, unseen_entity_slice, splits_by_year, top_codes, offer_bands,
        vehicle_programs, modal_value, vehicle_holders_all_sizes, order_keep_set, eligible_having, relative_size_loo,
    )
}

_K = "contract_award_unique_key"
_TX = """
raw as (select distinct * from action_ledger),
every as (select *, regexp_replace(trim(coalesce(modification_number, '')), '^"+|"+$', '', 'g') as m, coalesce(modification_number, '') as mod_str,
    coalesce(try_cast(transaction_number as bigint), 0) as txn_seq, year(action_date) + case when month(action_date) >= 10 then 1 else 0 end as fy
  from raw where action_date is not null and contract_award_unique_key is not null),
typed as (select *, regexp_full_match(upper(m), '[A-Z]*0+') as is_base_mod,
    coalesce(try_cast(nullif(regexp_extract(m, '([0-9]+)\\s*$', 1), '') as bigint), -1) as mod_seq from every),
tx as (select * from typed where award_type_code = 'D')
"""
_BASE = (
    _TX
    + """,
facts as (select contract_award_unique_key as k, min(action_date) as first_action_date, count_if(is_base_mod) as n_base_rows, count(*) as n_actions from tx group by 1),
firsts as (select * from tx where is_base_mod
  qualify row_number() over (partition by contract_award_unique_key order by action_date, mod_seq, txn_seq, mod_str, action_id) = 1),
base as (select f.k as contract_award_unique_key, b.* exclude (contract_award_unique_key), f.first_action_date, f.n_base_rows, f.n_actions,
    coalesce(b.action_date <= f.first_action_date, false) as base_is_first_action, b.fy as base_fy
  from facts f left join firsts b on b.contract_award_unique_key = f.k),
ident as (select * from base where n_base_rows > 0 and base_is_first_action and base_fy between 2010 and 2022)
"""
)
_STATE = (
    _BASE
    + """,
cut as (select i.contract_award_unique_key as k, i.action_id as base_id, h.horizon, cast(i.action_date + to_months(h.horizon) as date) as cutoff
  from ident i, (values (12), (24), (36)) h(horizon)),
seen as (select c.k, c.horizon, c.base_id, t.* from cut c join tx t on t.contract_award_unique_key = c.k and t.action_date <= c.cutoff),
state as (select k as contract_award_unique_key, horizon,
    max_by({'e': period_of_performance_current_end_date, 'd': action_date}, {'a': action_date, 'b': mod_seq, 'c': txn_seq, 'd': mod_str, 'e': action_id}) as latest,
    count(*) as n_actions,
    coalesce(sum(cast(base_and_all_options_value as decimal(20,2))) filter (action_id <> base_id), 0) as ceiling_delta,
    coalesce(sum(cast(base_and_exercised_options_value as decimal(20,2))) filter (action_id <> base_id), 0) as exercised_delta,
    coalesce(sum(cast(federal_action_obligation as decimal(20,2))), 0) as obligated,
    cast(coalesce(bool_or(action_type_code in ('E', 'F', 'X')), false) as int) as terminated,
    count(*) filter (action_type_code in ('A', 'D')) as change_orders,
    coalesce(sum(cast(base_and_all_options_value as decimal(20,2))) filter (action_type_code in ('A', 'D')), 0) as change_order_value,
    count(*) filter (action_type_code = 'G') as options
  from seen group by 1, 2)
"""
)
_LABELS = (
    _STATE
    + """,
joined as (select b.*, s.horizon, s.latest, s.ceiling_delta, s.terminated, s.change_orders, b.base_and_all_options_value > 0 as valid,
    date_diff('day', b.period_of_performance_current_end_date, s.latest.e) as slip_days,
    cast(b.action_date + to_months(s.horizon) as date) <= date '2023-09-30' as qualifies
  from ident b join state s using (contract_award_unique_key)),
grown as (select *, round(case when valid then cast(cast(base_and_all_options_value as decimal(20,2)) + ceiling_delta as double)
      / cast(cast(base_and_all_options_value as decimal(20,2)) as double) - 1 end, 10) as growth,
    round(case when valid then potential_total_value_of_award / base_and_all_options_value - 1 end, 10) as leak from joined),
labels as (select *, cast(growth > 0.1 as double) as gt10, cast(growth > 0.25 as double) as gt25, cast(growth > 0.5 as double) as gt50,
    cast(slip_days > 90 as double) as slip90, cast(slip_days > 365 as double) as slip365, cast(leak > 0.25 as double) as award_level_gt25,
    cast(change_orders > 0 as double) as any_change_order from grown)
"""
)
_PLACE = "regexp_matches(coalesce(recipient_name, ''), '(?i)\\b(MISCELLANEOUS|MULTIPLE|UNDISCLOSED|REDACTED|VARIOUS)\\b')"


def _history(name, group, source):
    value = "cast({} as decimal(24,10))"
    parts = []
    for c, e in (("growth", "case when growth is not null then greatest(-1, least(growth, 10)) end"), ("term", "cast(terminated as double)"), ("slip", "slip90")):
        parts.append(f"round(cast(sum({value.format(e)}) as double) / count({e}), 9) as {name}_{c}")
    return f"""
{name}_ev as (select *, {group} as g from labels where horizon = 36),
{name}_n as (select q.contract_award_unique_key as k, count(e.g) as {name}_n from {name}_ev q left join {name}_ev e on e.g = q.g and e.action_date < q.action_date where q.g is not null group by 1),
{name}_m as (select q.contract_award_unique_key as k, {", ".join(p.replace("growth is", "e.growth is").replace("least(growth", "least(e.growth").replace("cast(terminated", "cast(e.terminated").replace("(slip90", "(e.slip90").replace("count(slip90", "count(e.slip90") for p in parts)}
  from {name}_ev q join {name}_ev e on e.g = q.g and cast(e.action_date + to_months(36) as date) <= q.action_date where q.g is not null group by 1)"""


_HISTORY = _LABELS + "," + _history("rec", f"case when not {_PLACE} then recipient_uei end", "labels") + "," + _history("off", "awarding_office_code", "labels") + """,
hist as (select l.contract_award_unique_key, rn.rec_n as recipient_prior_award_count, rm.rec_growth as recipient_prior_mean_growth, rm.rec_term as recipient_prior_termination_rate,
    rm.rec_slip as recipient_prior_slip_rate, o.off_n as office_prior_award_count, om.off_growth as office_prior_mean_growth, om.off_term as office_prior_termination_rate, om.off_slip as office_prior_slip_rate
  from (select * from labels where horizon = 36) l left join rec_n rn on rn.k = l.contract_award_unique_key left join rec_m rm on rm.k = l.contract_award_unique_key
  left join off_n o on o.k = l.contract_award_unique_key left join off_m om on om.k = l.contract_award_unique_key)
"""

SQL = {
    "ledger_scan_typed": f"with {_TX} select source_fiscal_year as fy, is_base_mod, count(*) as n_actions, count(distinct {_K}) as n_awards, min(action_date) as first_date, max(action_date) as last_date, cast(sum(mod_seq) as bigint) as sum_mod_seq, cast(sum(txn_seq) as bigint) as sum_txn_seq from tx group by 1, 2",
    "order_ledger_scan": f"with {_TX} select fy, count(*) as n_actions, count(distinct {_K}) as n_orders from typed where award_type_code = 'C' group by 1",
    "year_gaps": "with y as (select distinct source_fiscal_year as fy from action_ledger) select cast(u.fy as int) as fy from (select unnest(generate_series((select min(fy) from y), (select max(fy) from y))) as fy) u where u.fy not in (select fy from y where fy is not null)",
    "years_present": "with y as (select source_fiscal_year as fy, count(*) as n from action_ledger where source_fiscal_year is not null group by 1), u as (select unnest(generate_series((select min(fy) from y), (select max(fy) from y))) as fy) select cast(u.fy as int) as fy, cast(coalesce(n, 0) as bigint) as n_actions, n is null as is_gap from u left join y using (fy)",
    "action_type_counts": f"with raw as (select distinct * from action_ledger) select award_type_code, action_type_code, count(*) as n, count(distinct {_K}) as n_awards from raw group by 1, 2",
    "archive_recount": f"select count(*) as n_rows, count_if(award_type_code = 'D') as n_type_d, count(distinct case when award_type_code = 'D' then {_K} end) as n_awards_d, count(*) - count(distinct action_id) as n_redelivered from action_ledger",
    "award_base_row": f"with {_BASE} select {_K}, action_id, action_date, first_action_date, n_base_rows, n_actions, base_is_first_action, cast(base_fy as int) as base_fy from base",
    "horizon_state_12_24_36": f"with {_STATE} select {_K}, horizon, latest.e as current_end, latest.d as last_action_date, n_actions, cast(ceiling_delta as double) as ceiling_delta, cast(exercised_delta as double) as exercised_delta, cast(obligated as double) as obligated, terminated, change_orders, cast(change_order_value as double) as change_order_value, options from state",
    "award_labels": f"with {_LABELS} select {_K}, horizon, qualifies, growth, gt10, gt25, gt50, cast(slip_days as int) as slip_days, slip90, slip365, award_level_gt25, any_change_order, terminated from labels",
    "funnel": f"""with {_BASE}, c as (select n_base_rows > 0 as c1, base_is_first_action as c2, coalesce(base_fy between 2010 and 2022, false) as c3, n_base_rows <= 1 as c4,
        coalesce(federal_action_obligation >= 250000, false) as c5, period_of_performance_current_end_date is not null as c6, coalesce(base_and_all_options_value > 0, false) as c7 from base)
        select 0 as step, 'start' as filter, count(*) as n from c union all select 1, 'explicit base modification', count_if(c1) from c
        union all select 2, 'base is first action', count_if(c1 and c2) from c union all select 3, 'years covered', count_if(c1 and c2 and c3) from c
        union all select 4, 'single base row', count_if(c1 and c2 and c3 and c4) from c union all select 5, 'obligation at threshold', count_if(c1 and c2 and c3 and c4 and c5) from c
        union all select 6, 'end date known', count_if(c1 and c2 and c3 and c4 and c5 and c6) from c union all select 7, 'ceiling positive', count_if(c1 and c2 and c3 and c4 and c5 and c6 and c7) from c""",
    "award_history": f"with {_HISTORY} select * from hist",
    "award_panel": f"""with {_HISTORY} select l.{_K}, cast(l.base_fy as int) as base_fy, substr(naics_code, 1, 2) as naics2, substr(product_or_service_code, 1, 1) as psc1,
        round(log10(greatest(federal_action_obligation, 1)), 6) as log_base_obligation, round(case when base_and_all_options_value > 0 then log10(base_and_all_options_value) end, 6) as log_base_ceiling,
        round(case when base_and_exercised_options_value > 0 then base_and_all_options_value / base_and_exercised_options_value end, 6) as option_heaviness,
        cast(date_diff('day', period_of_performance_start_date, period_of_performance_current_end_date) as int) as planned_duration_days,
        cast(date_diff('day', period_of_performance_current_end_date, period_of_performance_potential_end_date) as int) as potential_extra_duration_days,
        cast(number_of_offers_received is null as int) as n_offers_missing, cast(month(action_date) as int) as base_month, cast(month(action_date) = 9 as int) as base_is_september,
        growth as ceiling_growth_36, recipient_prior_award_count, office_prior_slip_rate
        from labels l join hist h on h.{_K} = l.{_K} where l.horizon = 36 and n_base_rows <= 1 and federal_action_obligation >= 250000 and period_of_performance_current_end_date is not null and base_and_all_options_value > 0""",
    "base_rates_rollup": f"""with {_LABELS}, r as (select * from labels where qualifies),
        u as (select base_fy, horizon, unnest(['gt10', 'gt25', 'gt50', 'slip90', 'slip365', 'any_change_order', 'terminated']) as label, unnest([gt10, gt25, gt50, slip90, slip365, any_change_order, cast(terminated as double)]) as y from r)
        select label, horizon, coalesce(cast(base_fy as varchar), 'ALL') as fy, count(y) as n, round(avg(y), 9) as rate from u group by grouping sets ((label, horizon, base_fy), (label, horizon))""",
    "leak_comparison": f"""with {_LABELS}, r as (select *, gt25 is not null and award_level_gt25 is not null as both_known from labels where qualifies)
        select horizon, count_if(both_known) as n_both, round(avg(gt25) filter (both_known), 9) as rate_reconstructed, round(avg(award_level_gt25) filter (both_known), 9) as rate_award_level,
        round(avg(cast(gt25 = award_level_gt25 as double)) filter (both_known), 9) as agreement from r group by 1""",
    "continuous_summary": f"""with {_LABELS} select horizon, count(*) as n, round(cast(sum(cast(growth as decimal(24,10))) as double) / count(*), 8) as mean, round(stddev_samp(growth), 6) as sd,
        round(quantile_cont(growth, 0.01), 8) as p01, round(quantile_cont(growth, 0.25), 8) as p25, round(quantile_cont(growth, 0.5), 8) as p50, round(quantile_cont(growth, 0.75), 8) as p75,
        round(quantile_cont(growth, 0.9), 8) as p90, round(quantile_cont(growth, 0.99), 8) as p99, round(avg(cast(growth = 0 as double)), 9) as share_zero from labels where qualifies and growth is not null group by 1""",
    "running_reconstruction": f"""with {_TX}, r as (select *, sum(cast(base_and_all_options_value as decimal(20,2))) over (partition by {_K} order by action_date, mod_seq, txn_seq, mod_str, action_id rows unbounded preceding) as rebuilt from tx)
        select cast(fy as int) as fy, count(*) as n, round(avg(cast(abs(cast(rebuilt as double) - potential_total_value_of_award) <= greatest(1, 0.01 * greatest(abs(cast(rebuilt as double)), abs(potential_total_value_of_award))) as double)), 9) as share_agreeing
        from r where rebuilt is not null and potential_total_value_of_award is not null group by 1""",
    "restatement_share": f"""with {_TX}, r as (select *, row_number() over w as from_end, first_value(potential_total_value_of_award) over w as final from tx window w as (partition by {_K} order by action_date desc, mod_seq desc, txn_seq desc, mod_str desc, action_id desc))
        select cast(fy as int) as fy, count(*) as n, round(avg(cast(abs(potential_total_value_of_award - final) <= greatest(1, 0.01 * greatest(abs(potential_total_value_of_award), abs(final))) as double)), 9) as share_final
        from r where from_end > 1 and final is not null and potential_total_value_of_award is not null group by 1""",
    "last_nonfinal": f"""with {_TX}, r as (select *, sum(cast(federal_action_obligation as decimal(20,2))) over (partition by {_K} order by action_date, mod_seq, txn_seq, mod_str, action_id rows unbounded preceding) as total from tx),
        s as (select *, lag(total) over (partition by {_K} order by action_date, mod_seq, txn_seq, mod_str, action_id) as before from r)
        select action_type_code, count(*) as n, round(avg(cast(total >= before as double)), 9) as share_not_down from s where before is not null and total is not null group by 1""",
    "fill_rates": f"""with {_BASE}, u as (select base_fy, unnest(['number_of_offers_received', 'extent_competed_code', 'type_of_contract_pricing_code', 'recipient_uei', 'base_and_all_options_value']) as field,
        unnest([number_of_offers_received is not null, extent_competed_code is not null, type_of_contract_pricing_code is not null, recipient_uei is not null, base_and_all_options_value is not null]) as filled from ident)
        select cast(base_fy as int) as base_fy, field, count(*) as n, round(avg(cast(filled as double)), 9) as share_filled from u group by 1, 2""",
    "name_fragmentation": f"""with {_BASE}, i as (select recipient_name, recipient_uei, count(*) as n from base where recipient_name is not null and recipient_uei is not null group by 1, 2)
        select recipient_name, count(*) as n_ids, cast(sum(n) as bigint) as n_awards, round(max(n) / sum(n), 9) as largest_share from i group by 1 order by n_ids desc, n_awards desc, recipient_name limit 8""",
    "placeholder_recipients": f"with {_BASE} select {_PLACE} as is_placeholder, recipient_uei is null as no_id, count(*) as n_awards from base group by 1, 2",
    "censoring_rollup": f"""with {_LABELS} select coalesce(cast(base_fy as varchar), 'ALL') as fy, count_if(qualifies and horizon = 12) as n_12, count_if(qualifies and horizon = 24) as n_24, count_if(qualifies and horizon = 36) as n_36, count_if(horizon = 12) as n
        from labels group by rollup (base_fy)""",
    "unseen_entity_slice": f"""with {_BASE}, u as (select recipient_uei, base_fy from ident where recipient_uei is not null and not {_PLACE}), s as (select distinct recipient_uei from u where base_fy between 2010 and 2017)
        select case when recipient_uei in (select recipient_uei from s) then 'seen' else 'unseen' end as slice, count(*) as n from u where base_fy between 2020 and 2022 group by 1""",
    "splits_by_year": f"""with {_BASE} select case when base_fy between 2010 and 2017 then 'train' when base_fy between 2018 and 2019 then 'val' when base_fy between 2020 and 2022 then 'test' end as split,
        count(*) as n, cast(min(base_fy) as int) as first_fy, cast(max(base_fy) as int) as last_fy from ident group by 1""",
    "top_codes": f"with {_TX} select product_or_service_code, count(*) as n from tx where product_or_service_code is not null group by 1 order by n desc, product_or_service_code limit 20",
    "offer_bands": f"""with {_BASE} select case when number_of_offers_received = 2 then '2' when number_of_offers_received = 3 then '3' when number_of_offers_received between 4 and 5 then '4-5' when number_of_offers_received between 6 and 10 then '6-10'
        when number_of_offers_received between 11 and 20 then '11-20' when number_of_offers_received >= 21 then '21+' end as band, count(*) as n,
        round(cast(sum(cast(federal_action_obligation as decimal(20,2))) as double) / count(federal_action_obligation), 4) as mean_obligation from ident group by 1""",
    "vehicle_programs": f"""with {_BASE}, v as (select {_K} as k, min(nullif(regexp_replace(upper(vehicle), '[^A-Z0-9]', '', 'g'), '')) as sol from action_ledger where vehicle is not null group by 1),
        r as (select b.{_K} as k, nullif(regexp_extract(b.{_K}, '_([^_]+)$', 1), '') as agency, sol, recipient_uei from base b join v on v.k = b.{_K}),
        s as (select agency, sol, count(*) as n, count(distinct recipient_uei) as m from r group by 1, 2)
        select case when n >= 2 and m >= 2 then agency || '|' || sol else k end as program, count(*) as n_members from r join s using (agency, sol) group by 1""",
    "modal_value": """with r as (select distinct * from action_ledger where vehicle is not null), c as (select vehicle, type_of_contract_pricing_code as p, count(*) as n from r where type_of_contract_pricing_code is not null group by 1, 2),
        m as (select vehicle, p as modal_pricing from c qualify row_number() over (partition by vehicle order by n desc, p) = 1),
        f as (select vehicle, min(action_date) as first_date, count(*) as n_actions from r group by 1),
        x as (select vehicle, extent_competed_code as first_competed from r where extent_competed_code is not null qualify row_number() over (partition by vehicle order by action_date nulls first, action_id) = 1)
        select vehicle, first_competed, first_date, n_actions, modal_pricing from f left join x using (vehicle) left join m using (vehicle)""",
    "vehicle_holders_all_sizes": f"with r as (select distinct * from action_ledger where vehicle is not null) select vehicle, recipient_uei, cast(year(action_date) + case when month(action_date) >= 10 then 1 else 0 end as int) as fy, count(*) as n_actions, count(distinct {_K}) as n_awards from r group by 1, 2, 3",
    "order_keep_set": f"""with {_TX}, o as (select * from typed where award_type_code = 'C'), k as (select {_K}, min(fy) as since from o where is_base_mod and federal_action_obligation >= 250000 group by 1)
        select cast(fy as int) as fy, count(*) as n_actions, count(distinct {_K}) as n_orders from o join k using ({_K}) where fy >= since group by 1""",
    "eligible_having": f"""with {_BASE}, v as (select distinct {_K} as k from action_ledger where vehicle is not null), r as (select i.* from ident i join v on v.k = i.{_K} where recipient_uei is not null)
        select awarding_office_code, count_if(base_fy between 2010 and 2017) as n_train, count(distinct case when base_fy between 2010 and 2017 then recipient_uei end) as n_holders, count_if(base_fy between 2020 and 2022) as n_test
        from r group by 1 having count_if(base_fy between 2010 and 2017) >= 5 and count(distinct case when base_fy between 2010 and 2017 then recipient_uei end) >= 3 and count_if(base_fy between 2020 and 2022) >= 2""",
    "relative_size_loo": f"""with {_BASE}, r as (select {_K}, cast(round(log10(greatest(federal_action_obligation, 1)), 8) as decimal(20,8)) as x, awarding_agency_code as a, substr(product_or_service_code, 1, 1) as p, base_fy from ident where awarding_agency_code is not null and product_or_service_code is not null),
        w as (select *, count(x) over (partition by a, p, base_fy) as n, sum(x) over (partition by a, p, base_fy) as s from r)
        select {_K}, round(cast(x as double) - cast(s - x as double) / (n - 1), 7) as relative_size from w where n >= 5 and x is not null""",
}
