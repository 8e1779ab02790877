"""Awards from a ledger of actions: base row, state at horizons, labels, features, history, scope.

The base action of an award carries levels, every later action carries changes.  All horizons are read in
one aggregation of the ledger by award, and all picks are partial minima and maxima, so an award with very
many actions is combined before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as E
from ..session import cut_lineage

#: Last day that the ledger is taken to cover.
DATA_END = "2023-09-30"
FIRST_YEAR, LAST_YEAR = 2010, 2022
#: Base obligation from which an award is in scope.
THRESHOLD = 250_000.0
KEY = "contract_award_unique_key"


def money(c: Column) -> Column:
    return c.cast("decimal(20,2)")


def load_actions(ledger: DataFrame, award_type: str = "D") -> DataFrame:
    """Actions of one award type with a date and a key, each once, with the keys of their total order."""
    return (
        ledger.where((F.col("award_type_code") == award_type) & F.col("action_date").isNotNull() & F.col(KEY).isNotNull())
        .dropDuplicates(["action_id"])
        .withColumn("mod_seq", E.mod_sequence(F.col("modification_number")))
        .withColumn("txn_seq", F.coalesce(F.col("transaction_number").try_cast("bigint"), F.lit(0)))
        .withColumn("is_base_mod", E.is_base_mod(F.col("modification_number")))
        .withColumn("mod_str", F.coalesce("modification_number", F.lit("")))
    )


def action_order() -> Column:
    return F.struct("action_date", "mod_seq", "txn_seq", "mod_str", "action_id")


_CARRIED = (
    "action_id", "action_date", "federal_action_obligation", "base_and_all_options_value", "base_and_exercised_options_value",
    "potential_total_value_of_award", "period_of_performance_start_date", "period_of_performance_current_end_date",
    "period_of_performance_potential_end_date", "recipient_uei", "recipient_name", "awarding_agency_code", "awarding_office_code",
    "naics_code", "product_or_service_code", "type_of_contract_pricing_code", "extent_competed_code", "number_of_offers_received",
)


def base_rows(actions: DataFrame) -> DataFrame:
    """One row per award: its base action's columns (null without one) and how its actions stand to it."""
    carried = F.struct(*_CARRIED)
    return (
        actions.groupBy(KEY)
        .agg(
            F.min_by(carried, F.when(F.col("is_base_mod"), action_order())).alias("b"),
            F.min("action_date").alias("first_action_date"),
            F.count_if("is_base_mod").alias("n_base_rows"),
            F.count("*").alias("n_actions"),
        )
        .select(KEY, "b.*", "first_action_date", "n_base_rows", "n_actions")
        .withColumn("has_explicit_base", F.col("n_base_rows") > 0)
        .withColumn("has_single_base_row", F.col("n_base_rows") <= 1)
        .withColumn("base_is_first_action", F.coalesce(F.col("action_date") <= F.col("first_action_date"), F.lit(False)))
        .withColumn("base_fy", E.fiscal_year(F.col("action_date")))
    )


def identified(base: DataFrame) -> DataFrame:
    """Awards whose explicit base action is their first action, in the years covered: the source of histories."""
    return base.where(F.col("has_explicit_base") & F.col("base_is_first_action") & F.col("base_fy").between(FIRST_YEAR, LAST_YEAR))


def in_scope(labels: DataFrame) -> DataFrame:
    """Awards to be forecast; applied after labels and history, never before."""
    return labels.where(
        F.col("has_single_base_row")
        & (F.col("federal_action_obligation") >= THRESHOLD)
        & F.col("period_of_performance_current_end_date").isNotNull()
        & (F.col("base_and_all_options_value") > 0)
    )


def states_at_horizons(actions: DataFrame, base: DataFrame, horizons: tuple[int, ...] = E.HORIZONS) -> DataFrame:
    """Per award of ``base`` and for every horizon, in columns ending with it: the latest action's end date and
    date, action counts, sums of changes and terminations up to and including the horizon's day."""
    start = base.select(KEY, F.col("action_date").alias("__start"), F.col("action_id").alias("__base"))
    rows = actions.join(start, KEY)
    is_delta = F.col("action_id") != F.col("__base")
    out = []
    for h in horizons:
        seen = F.col("action_date") <= F.add_months("__start", h)
        code = F.col("action_type_code")

        def total(c, cond=None, seen=seen):
            return F.coalesce(F.sum(F.when(seen if cond is None else seen & cond, money(F.col(c)))), F.lit(0).cast("decimal(30,2)"))

        last = F.max_by(F.struct("period_of_performance_current_end_date", "action_date"), F.when(seen, action_order()))
        out += [
            last.getField("period_of_performance_current_end_date").alias(f"current_end_at_{h}"),
            last.getField("action_date").alias(f"last_action_date_by_{h}"),
            F.count_if(seen).alias(f"n_actions_by_{h}"),
            total("base_and_all_options_value", is_delta).alias(f"ceiling_delta_by_{h}"),
            total("base_and_exercised_options_value", is_delta).alias(f"exercised_delta_by_{h}"),
            total("federal_action_obligation").alias(f"obligated_by_{h}"),
            F.coalesce(F.bool_or(seen & code.isin(*E.TERMINATIONS)), F.lit(False)).cast("int").alias(f"terminated_{h}"),
            F.count_if(seen & code.isin(*E.CHANGE_ORDERS)).alias(f"change_order_count_{h}"),
            total("base_and_all_options_value", code.isin(*E.CHANGE_ORDERS)).alias(f"change_order_value_{h}"),
            F.count_if(seen & (code == "G")).alias(f"option_exercise_count_{h}"),
        ]
    return rows.groupBy(KEY).agg(*out)


def outcome_labels(base: DataFrame, states: DataFrame, horizons: tuple[int, ...] = E.HORIZONS, data_end: str = DATA_END) -> DataFrame:
    """Growth of the ceiling and slip of the end date at every horizon; null, not 0, where they can't be told."""
    ceiling = money(F.col("base_and_all_options_value"))
    valid = F.col("base_and_all_options_value") > 0
    columns = []
    for h in horizons:
        growth = F.when(valid, (ceiling + F.col(f"ceiling_delta_by_{h}")).cast("double") / ceiling.cast("double") - 1)
        rounded = F.round(growth, 10)
        slip = F.datediff(f"current_end_at_{h}", "period_of_performance_current_end_date")
        leak = F.round(F.when(valid, F.col("potential_total_value_of_award") / F.col("base_and_all_options_value") - 1), 10)
        columns += [
            (F.add_months("action_date", h) <= F.lit(data_end).cast("date")).alias(f"qualifies_{h}"),
            rounded.alias(f"ceiling_growth_{h}"),
            *[F.when(growth.isNotNull(), (rounded > t).cast("double")).alias(f"ceiling_growth_gt{int(t * 100)}_{h}") for t in (0.1, 0.25, 0.5)],
            slip.alias(f"schedule_slip_days_{h}"),
            *[F.when(slip.isNotNull(), (slip > d).cast("double")).alias(f"schedule_slip_gt{d}_{h}") for d in (90, 365)],
            F.when(leak.isNotNull(), (leak > 0.25).cast("double")).alias(f"award_level_gt25_{h}"),
            F.round(F.when(valid, F.col(f"change_order_value_{h}").cast("double") / F.col("base_and_all_options_value")), 10).alias(f"unplanned_growth_{h}"),
            (F.col(f"change_order_count_{h}") > 0).cast("double").alias(f"any_change_order_{h}"),
        ]
    return base.join(states, KEY).select("*", *columns)


def base_features(labels: DataFrame) -> DataFrame:
    ceiling, exercised = F.col("base_and_all_options_value"), F.col("base_and_exercised_options_value")
    return labels.select(
        "*",
        F.substring("naics_code", 1, 2).alias("naics2"),
        F.substring("product_or_service_code", 1, 1).alias("psc1"),
        F.log10(F.greatest("federal_action_obligation", F.lit(1.0))).alias("log_base_obligation"),
        F.when(ceiling > 0, F.log10(ceiling)).alias("log_base_ceiling"),
        F.when(exercised > 0, ceiling / exercised).alias("option_heaviness"),
        F.datediff("period_of_performance_current_end_date", "period_of_performance_start_date").alias("planned_duration_days"),
        F.datediff("period_of_performance_potential_end_date", "period_of_performance_current_end_date").alias("potential_extra_duration_days"),
        F.col("number_of_offers_received").isNull().cast("int").alias("n_offers_missing"),
        F.month("action_date").alias("base_month"),
        (F.month("action_date") == 9).cast("int").alias("base_is_september"),
    )


def daily_history(events: DataFrame, group: str, day: str, resolved_day: Column, values: dict[str, Column]) -> DataFrame:
    """(group, day, n_before, <name>_n, <name>_mean): per group and day of an event, how many events came strictly
    before, and of those whose outcome was resolved by that day, how many have a value and its mean.

    Events are added up per group and day before anything is ordered, so the running totals of a group go
    over days, not over its events.  Null groups take no part.
    """
    scale = "decimal(24,10)"
    rows = events.where(F.col(group).isNotNull() & F.col(day).isNotNull())
    base = rows.select(F.col(group).alias("g"), F.col(day).alias("d"), F.lit(1).alias("n"), *[F.lit(None).cast(scale).alias(f"v_{k}") for k in values])
    done = rows.select(F.col(group).alias("g"), resolved_day.alias("d"), F.lit(0).alias("n"), *[v.cast(scale).alias(f"v_{k}") for k, v in values.items()])
    daily = base.unionByName(done).groupBy("g", "d").agg(
        F.sum("n").alias("n"),
        *[F.sum(f"v_{k}").alias(f"s_{k}") for k in values],
        *[F.count(f"v_{k}").alias(f"c_{k}") for k in values],
    )
    past = Window.partitionBy("g").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.select(
        "g",
        "d",
        "n",
        (F.sum("n").over(past) - F.col("n")).alias("n_before"),
        *[F.sum(f"c_{k}").over(past).alias(f"{k}_n") for k in values],
        *[F.sum(f"s_{k}").over(past).cast("double").alias(f"__{k}") for k in values],
    ).where("n > 0")
    return out.select(
        F.col("g").alias(group), F.col("d").alias(day), "n_before", *[f"{k}_n" for k in values], *[F.round(F.try_divide(F.col(f"__{k}"), F.col(f"{k}_n")), 9).alias(f"{k}_mean") for k in values]
    )


def add_history(labels: DataFrame, months: int = 36) -> DataFrame:
    """Track records of recipient and office strictly as of the base date.

    Prior awards count when dated strictly before; outcomes only when their horizon had closed by then.  A
    missing key and a placeholder recipient neither give nor get a history.
    """
    growth = F.greatest(F.lit(-1.0), F.least(F.col(f"ceiling_growth_{months}"), F.lit(10.0)))
    growth = F.when(F.col(f"ceiling_growth_{months}").isNotNull(), growth)
    values = {"growth": growth, "terminated": F.col(f"terminated_{months}"), "slip": F.col(f"schedule_slip_gt90_{months}")}
    # read three times below, so the labels are computed once and kept
    labels = cut_lineage(labels)
    out = labels.withColumn("__recipient", F.when(~E.is_aggregate_recipient(F.col("recipient_name")), F.col("recipient_uei")))
    for name, key in (("recipient", "__recipient"), ("office", "awarding_office_code")):
        history = daily_history(out, key, "action_date", F.add_months("action_date", months), values)
        history = history.select(
            key,
            "action_date",
            F.col("n_before").alias(f"{name}_prior_award_count"),
            F.col("growth_mean").alias(f"{name}_prior_mean_growth"),
            F.col("terminated_mean").alias(f"{name}_prior_termination_rate"),
            F.col("slip_mean").alias(f"{name}_prior_slip_rate"),
        )
        out = out.join(history, [key, "action_date"], "left")
    return out.drop("__recipient")


def award_labels(ledger: DataFrame, award_type: str = "D") -> DataFrame:
    actions = load_actions(ledger, award_type)
    base = identified(base_rows(actions))
    return outcome_labels(base, states_at_horizons(actions, base))


def award_panel(ledger: DataFrame) -> DataFrame:
    """The whole pipeline in its one right order: labels and history on the wide population, scope last."""
    return in_scope(add_history(base_features(award_labels(ledger))))
