"""Queries of tenders, lots and the contract registry."""

from pyspark.sql import functions as F

from ..operators import tenders as T
from ..session import table
from .nested_records import _DOCS, _kids


def _rows(spark, sf_dir):
    return T.tender_rows(table(spark, sf_dir, "tender_records"))


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else c for c in df.columns])


def tender_table(spark, sf_dir):
    return T.tenders(_rows(spark, sf_dir)).select(
        "tender_id", "tender_code", "method", "status", "buyer_scheme", "buyer_id", "buyer_name", "buyer_kind", "cpv_division", "cpv_group", "main_category", "expected_value", "currency", "vat_incl", "n_lots", "n_bids",
        "n_bid_entries", "n_bids_no_price", "n_awards", "n_awards_active", "n_awards_unsuccessful", "n_contracts", "created_date", "year", "invasion",
    )


def tender_lot_frame(spark, sf_dir):
    return T.lot_frame(_rows(spark, sf_dir))


def tender_bids(spark, sf_dir):
    columns = ["tender_id", "lot_id", "bid_id", "bidder_id", "bidder_name", "amount", "status", "live", "rank_in_lot", "n_live", "won_lot", "disqualified", "discount", "lot_expected_value", "lot_cpv_division"]
    return _rounded(T.bids_by_lot(_rows(spark, sf_dir)).select(*columns), "discount")


def tender_lots(spark, sf_dir):
    columns = ["tender_id", "lot_id", "n_bids", "min_bid", "max_bid", "n_disqualified", "lowest_disqualified", "bid_cv", "bid_spread", "winner_bid_id", "winner_id", "winner_amount", "winner_rank", "winner_is_lowest"]
    return _rounded(T.lots_with_winners(_rows(spark, sf_dir)).select(*columns), "bid_cv", "bid_spread")


def registry_changes(spark, sf_dir):
    columns = ["contract_id", "of_tender", "reg_status", "reg_value", "n_changes", "n_changes_active", "rationales", "n_duration_extension", "n_tax_rate", "n_duration_changes"]
    rows = T.registry_rows(_rows(spark, sf_dir))
    return rows.select(*columns, F.unix_seconds("first_change").alias("first_change"), F.unix_seconds("first_duration_change").alias("first_duration_change"))


def contract_registry(spark, sf_dir):
    columns = ["tender_id", "contract_id", "award_id", "lot_id", "status", "amount", "winning_bid_id", "award_status", "award_value", "reg_status", "n_changes"]
    return T.contracts_with_registry(_rows(spark, sf_dir)).select(*columns)


def lot_outcome_labels(spark, sf_dir):
    return _rounded(T.lot_outcomes(_rows(spark, sf_dir)).drop("winner_discount", "log_value"), "days_extended", "value_ratio", "paid_ratio")


QUERIES = {f.__name__: f for f in (tender_table, tender_lot_frame, tender_bids, tender_lots, registry_changes, contract_registry, lot_outcome_labels)}


def _numbered(name: str, child_id: str) -> str:
    """(tid, x, o): the children of tenders under a key with their places."""
    return f"(select tid, x, o from (select tid, unnest(l) as x, generate_subscripts(l, 1) as o from (select tid, {_kids(f"(j->'$.{name}')", child_id)} as l from t)) where json_type(x) = 'OBJECT')"


_AMOUNT = "try_cast({0}->>'$.value.amount' as double)"
_LIVE = "coalesce({0} not in ('deleted', 'draft', 'invalid.pre-qualification'), true)"
_TENDERS = f"""{_DOCS}, t as (select j->>'$.id' as tid, j from d where j->>'$.tenderID' is not null and trim(j->>'$.id') <> ''),
  lot as (select tid, x->>'$.id' as lot, {_AMOUNT.format('x')} as ev, try_cast(x->>'$.value.valueAddedTaxIncluded' as boolean) as vat, x->>'$.status' as status from {_numbered('lots', 'id')} where trim(x->>'$.id') <> ''),
  nl as (select tid, count(*) as n, min(lot) as lone from lot group by 1),
  al as (select tid, lot, ev, vat, status, n = 1 as only_lot from lot join nl using (tid) union all select tid, tid, {_AMOUNT.format('j')}, try_cast(j->>'$.value.valueAddedTaxIncluded' as boolean), j->>'$.status', true from t where tid not in (select tid from lot)),
  def as (select t.tid, case when n = 1 then lone when n is null then t.tid end as def from t left join nl using (tid)),
  it as (select tid, nullif(x->>'$.relatedLot', '') as lot, x->>'$.classification.id' as code, o from {_numbered('items', 'id')} where x->>'$.classification.id' <> ''),
  cd as (select tid, lot, arg_max(code, n * 1000000 - f) as code from (select tid, lot, code, count(*) as n, min(o) as f from (select * from it where lot is not null union all select tid, null, code, o from it) group by all) group by 1, 2),
  lf as (select al.*, coalesce(a.code, b.code) as code from al left join cd a on a.tid = al.tid and a.lot = al.lot left join cd b on b.tid = al.tid and b.lot is null),
  aw as (select tid, x->>'$.id' as aid, coalesce(nullif(x->>'$.lotID', ''), def, tid) as lot, nullif(x->>'$.bid_id', '') as bid, x->>'$.status' as status, {_AMOUNT.format('x')} as amount, o from {_numbered('awards', 'id')} join def using (tid)),
  win as (select tid, lot, arg_max(bid, o) as bid from aw where status = 'active' and bid is not null group by 1, 2), dis as (select distinct tid, lot, bid from aw where status = 'unsuccessful' and bid is not null),
  bid as (select tid, x->>'$.id' as bid, x from {_numbered('bids', 'id')} where trim(x->>'$.id') <> ''),
  pr as (select tid, bid, x, y from (select tid, bid, x, unnest({_kids("(x->'$.lotValues')", 'relatedLot')}) as y from bid) where json_type(y) = 'OBJECT'),
  pb as (select tid, coalesce(nullif(y->>'$.relatedLot', ''), tid) as lot, bid, x, {_AMOUNT.format('y')} as amount from pr union all select tid, coalesce(def, tid), bid, x, {_AMOUNT.format('x')} from bid join def using (tid)
    where json_type(x->'$.value') <> 'NULL' and not exists (select 1 from pr where pr.tid = bid.tid and pr.bid = bid.bid)),
  lb as (select pb.tid as tender_id, pb.lot as lot_id, pb.bid as bid_id, x->>'$.tenderers[0].identifier.id' as bidder_id, coalesce(nullif(x->>'$.tenderers[0].name', ''), x->>'$.tenderers[0].identifier.legalName') as bidder_name, pb.amount, x->>'$.status' as status,
    {_LIVE.format("x->>'$.status'")} and pb.amount is not null as live, coalesce(pb.bid = win.bid, false) as won_lot, dis.bid is not null as disqualified, lf.ev as lot_expected_value, substr(lf.code, 1, 2) as lot_cpv_division
    from pb left join win on win.tid = pb.tid and win.lot = pb.lot left join dis on dis.tid = pb.tid and dis.lot = pb.lot and dis.bid = pb.bid left join lf on lf.tid = pb.tid and lf.lot = pb.lot),
  rb as (select *, case when live then rank() over (partition by tender_id, lot_id, live order by amount) end as rank_in_lot, case when live then count(*) over (partition by tender_id, lot_id, live) end as n_live from lb),
  tl as (select tender_id, lot_id, count(distinct bid_id) as n_bids, min(amount) as min_bid, max(amount) as max_bid, count(*) filter (disqualified) as n_disqualified, bool_or(disqualified and rank_in_lot = 1) as lowest_disqualified,
    case when avg(amount) > 0 then stddev_samp(amount) / avg(amount) end as bid_cv, case when min(amount) > 0 then max(amount) / min(amount) - 1 end as bid_spread, max(lot_expected_value) as lot_expected_value,
    arg_min(bid_id, (amount, bid_id)) filter (won_lot) as winner_bid_id, arg_min(bidder_id, (amount, bid_id)) filter (won_lot) as winner_id, min(amount) filter (won_lot) as winner_amount, min(rank_in_lot) filter (won_lot) as winner_rank from rb where live group by 1, 2),
  la as (select tid, aid, arg_max(lot, o) as lot, arg_max(coalesce(bid, ''), o) as bid, arg_max(coalesce(status, ''), o) as status, max_by(amount, o) as amount from aw where aid is not null group by 1, 2),
  tc as (select c.tid as tender_id, x->>'$.id' as contract_id, x->>'$.awardID' as award_id, coalesce(la.lot, def.def, c.tid) as lot_id, x->>'$.status' as status, {_AMOUNT.format('x')} as amount, nullif(la.bid, '') as winning_bid_id, nullif(la.status, '') as award_status, la.amount as award_value,
    x->>'$.dateSigned' as signed, x->>'$.period.endDate' as period_end, try_cast(x->>'$.value.amountNet' as double) as amount_net, try_cast(x->>'$.value.valueAddedTaxIncluded' as boolean) as vat_incl
    from {_numbered('contracts', 'id')} c left join la on la.tid = c.tid and la.aid = x->>'$.awardID' left join def on def.tid = c.tid where trim(x->>'$.id') <> ''),
  g as (select j->>'$.id' as cid, j from d where j->>'$.tenderID' is null and trim(j->>'$.id') <> ''),
  ch as (select cid, x, try_cast(x->>'$.date' as timestamptz) as moment, nullif(x->>'$.date', '') as date, case when json_type(x->'$.rationaleTypes') = 'ARRAY' then list_filter(list_transform(json_extract_string(x, '$.rationaleTypes[*]'), lambda k: trim(k)), lambda k: k <> '')
      when json_type(x->'$.rationaleTypes') = 'VARCHAR' and trim(x->>'$.rationaleTypes') <> '' then [trim(x->>'$.rationaleTypes')] else [] end as kinds from (select cid, unnest({_kids("(j->'$.changes')", 'id')}) as x from g) where json_type(x) = 'OBJECT'),
  cn as (select cid, count(*) as n_changes, count(*) filter (x->>'$.status' = 'active') as n_changes_active, list_sort(list_distinct(flatten(list(kinds)))) as kinds, sum(len(list_filter(kinds, lambda k: k = 'durationExtension'))) as n_duration_extension, sum(len(list_filter(kinds, lambda k: k = 'taxRate'))) as n_tax_rate,
    count(*) filter (list_contains(kinds, 'durationExtension')) as n_duration_changes, case when count(*) = count(date) then min(moment) end as first_change, case when bool_and(date is not null or not list_contains(kinds, 'durationExtension')) then min(moment) filter (list_contains(kinds, 'durationExtension')) end as first_duration_change from ch group by 1),
  rg as (select g.cid as contract_id, coalesce(j->>'$._tender_id', j->>'$.tender_id') as of_tender, j->>'$.status' as reg_status, {_AMOUNT.format('j')} as reg_value, try_cast(j->>'$.value.amountNet' as double) as reg_value_net, try_cast(j->>'$.value.valueAddedTaxIncluded' as boolean) as reg_vat, j->>'$.period.endDate' as reg_period_end,
    try_cast(j->>'$.amountPaid.amount' as double) as paid, try_cast(j->>'$.amountPaid.amountNet' as double) as paid_net, cast(coalesce(n_changes, 0) as bigint) as n_changes, cast(coalesce(n_changes_active, 0) as bigint) as n_changes_active, coalesce(array_to_string(kinds, '|'), '') as rationales,
    cast(coalesce(n_duration_extension, 0) as bigint) as n_duration_extension, cast(coalesce(n_tax_rate, 0) as bigint) as n_tax_rate, cast(coalesce(n_duration_changes, 0) as bigint) as n_duration_changes, first_change, first_duration_change from g left join cn using (cid)),
  cr as (select tc.*, rg.* exclude (contract_id) from tc left join rg using (contract_id)),
  pk as (select * from cr qualify row_number() over (partition by tender_id, lot_id order by coalesce(status <> 'cancelled', true) and coalesce(reg_status <> 'cancelled', true) desc, coalesce(signed, '') desc, contract_id desc) = 1),
  lo as (select tl.tender_id, tl.lot_id, n_bids, lot_expected_value, winner_id, contract_id, reg_status, n_duration_extension, n_changes, (epoch(try_cast(reg_period_end as timestamptz)) - epoch(try_cast(period_end as timestamptz))) / 86400 as ext,
    coalesce(nullif(reg_value_net, 0) / nullif(amount_net, 0), case when coalesce(reg_vat = vat_incl, true) then nullif(reg_value, 0) / nullif(amount, 0) end) as ratio,
    case when paid_net is not null and amount_net is not null then paid_net else paid end as p, case when paid_net is not null and amount_net is not null then amount_net else amount end as q from tl left join pk on pk.tender_id = tl.tender_id and pk.lot_id = tl.lot_id)"""
SQL = {
    "tender_table": f"""with {_TENDERS}, bc as (select tid, count(*) as n_bid_entries, count(*) filter ({_LIVE.format("x->>'$.status'")}) as n_bids, count(*) filter (coalesce(json_type(x->'$.value'), 'NULL') = 'NULL' and coalesce(cast(x->'$.lotValues' as varchar), 'null') in ('null', '[]', '{{}}')) as n_bids_no_price from bid group by 1),
      ac as (select tid, count(*) as n, count(*) filter (status = 'active') as a, count(*) filter (status = 'unsuccessful') as u from aw group by 1), cc as (select tender_id as tid, count(*) as n from tc group by 1)
      select t.tid as tender_id, j->>'$.tenderID' as tender_code, j->>'$.procurementMethodType' as method, j->>'$.status' as status, j->>'$.procuringEntity.identifier.scheme' as buyer_scheme, j->>'$.procuringEntity.identifier.id' as buyer_id,
      coalesce(nullif(j->>'$.procuringEntity.name', ''), j->>'$.procuringEntity.identifier.legalName') as buyer_name, j->>'$.procuringEntity.kind' as buyer_kind, substr(cd.code, 1, 2) as cpv_division, substr(cd.code, 1, 3) as cpv_group, j->>'$.mainProcurementCategory' as main_category,
      {_AMOUNT.format('j')} as expected_value, j->>'$.value.currency' as currency, try_cast(j->>'$.value.valueAddedTaxIncluded' as boolean) as vat_incl, cast(coalesce(nl.n, 0) as bigint) as n_lots, cast(coalesce(n_bids, 0) as bigint) as n_bids, cast(coalesce(n_bid_entries, 0) as bigint) as n_bid_entries,
      cast(coalesce(n_bids_no_price, 0) as bigint) as n_bids_no_price, cast(coalesce(ac.n, 0) as bigint) as n_awards, cast(coalesce(ac.a, 0) as bigint) as n_awards_active, cast(coalesce(ac.u, 0) as bigint) as n_awards_unsuccessful, cast(coalesce(cc.n, 0) as bigint) as n_contracts,
      coalesce(substr(j->>'$.tenderPeriod.startDate', 1, 10), '') as created_date, coalesce(substr(j->>'$.tenderPeriod.startDate', 1, 4), '') as year, coalesce(substr(j->>'$.tenderPeriod.startDate', 1, 10), '') >= '2022-02-24' as invasion
      from t left join cd on cd.tid = t.tid and cd.lot is null left join nl on nl.tid = t.tid left join bc on bc.tid = t.tid left join ac on ac.tid = t.tid left join cc on cc.tid = t.tid""",
    "tender_lot_frame": f"with {_TENDERS} select tid as tender_id, lot as lot_id, ev as expected_value, vat as vat_incl, status, substr(code, 1, 2) as division, substr(code, 1, 3) as grp, only_lot from lf",
    "tender_bids": f"""with {_TENDERS} select tender_id, lot_id, bid_id, bidder_id, bidder_name, amount, status, live, cast(rank_in_lot as int) as rank_in_lot, n_live, won_lot, disqualified,
      round(case when amount <> 0 and lot_expected_value <> 0 then 1 - amount / lot_expected_value end, 6) as discount, lot_expected_value, lot_cpv_division from rb""",
    "tender_lots": f"""with {_TENDERS} select tender_id, lot_id, n_bids, min_bid, max_bid, n_disqualified, lowest_disqualified, round(bid_cv, 6) as bid_cv, round(bid_spread, 6) as bid_spread, winner_bid_id, winner_id, winner_amount,
      cast(winner_rank as int) as winner_rank, coalesce(winner_rank = 1, false) as winner_is_lowest from tl""",
    "registry_changes": f"""with {_TENDERS} select contract_id, of_tender, reg_status, reg_value, n_changes, n_changes_active, rationales, n_duration_extension, n_tax_rate, n_duration_changes, cast(floor(epoch(first_change)) as bigint) as first_change,
      cast(floor(epoch(first_duration_change)) as bigint) as first_duration_change from rg""",
    "contract_registry": f"with {_TENDERS} select tender_id, contract_id, award_id, lot_id, status, amount, winning_bid_id, award_status, award_value, reg_status, n_changes from cr",
    "lot_outcome_labels": f"""with {_TENDERS} select tender_id, lot_id, n_bids, lot_expected_value, winner_id, contract_id, contract_id is not null as has_contract, reg_status is not null as has_registry, case when reg_status is not null then cast(n_duration_extension > 0 as int) end as duration_extension,
      case when reg_status is not null then cast(n_changes > 0 as int) end as any_change, round(ext, 6) as days_extended, cast(ext > 90 as int) as days_extended_gt90, round(ratio, 6) as value_ratio, cast(ratio > 1.10 as int) as value_growth_gt10,
      case when reg_status is not null then cast(reg_status = 'cancelled' as int) end as cancelled, round(case when p > 0 and q > 0 then p / q end, 6) as paid_ratio, cast(case when p > 0 and q > 0 then p / q end < 0.9 as int) as underexecuted from lo""",
}
