"""Queries over reported facts, macro snapshots and conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.operators import indicators as ind
from pitspark.operators.bars import pivot_fields
from pitspark.operators.bitemporal import locate, rectangles
from pitspark.operators.conditions import all_met, fold, outcome, replay, transitions
from pitspark.operators.normalise_times import with_instant
from pitspark.operators.pit import eligible, latest_revision, quality_name, quality_rank
from pitspark.operators.ratios import CORE, RATIOS, evaluate, history_statistics, percentile_rank, year_over_year
from pitspark.plans.market import _BARS, _RBARS, _W, DAY, KEYS, bars
from pitspark.plans.instant_sql import instants
from pitspark.plans.series import BARS_BY_DAY, bars_by_day, p1_found
from pitspark.session import micros_sql, table

FIELDS = ["revenue", "net_income", "total_assets", "total_liabilities", "shares_outstanding"]

#: The cut at which facts are read.
FACTS_KNOWN_AT = "2024-06-30 00:00:00"

_FACTS = f"""
with o as (select distinct * from observations where available_at <= timestamp '{FACTS_KNOWN_AT}' and asset_id is not null and field_name is not null and period_end is not null and available_at is not null and quality = 'valid'),
r as (select *, row_number() over (partition by asset_id, frequency, field_name, period_end::date order by available_at desc, observation_id) as k from o),
f as (select available_at, asset_id, frequency, replace(field_name, 'fundamental.', '') as field, period_end::date as period, obs_value as value, try_cast(json_extract_string(record_key, '$.fy') as int) as fy, json_extract_string(record_key, '$.fp') as fp from r where k = 1),
wide as (select asset_id, frequency, period, max(value) filter (field = 'revenue') as revenue, max(value) filter (field = 'net_income') as net_income, max(value) filter (field = 'total_assets') as total_assets,
  max(value) filter (field = 'total_liabilities') as total_liabilities, max(value) filter (field = 'shares_outstanding') as shares_outstanding from f group by 1, 2, 3)
"""


def facts(spark: SparkSession, sf_dir: str, known_at: str = FACTS_KNOWN_AT) -> DataFrame:
    """Each valid fact as known at the cut, the last of its revisions: asset_id, frequency, field, period (date), value, fy, fp."""
    o = eligible(table(spark, sf_dir, "observations"), F.lit(known_at).cast("timestamp_ntz")).where("asset_id is not null and field_name is not null and period_end is not null and available_at is not null and quality = 'valid'")
    keys = ["asset_id", "frequency", "field_name", "period"]
    moments = o.withColumn("period", F.to_date("period_end")).groupBy(*keys, "available_at").agg(F.min(F.struct("observation_id", "obs_value", "record_key")).alias("first"))
    best = moments.groupBy(*keys).agg(F.max_by("first", "available_at").alias("b"), F.max("available_at").alias("available_at"))
    return best.select(
        "available_at", "asset_id", "frequency", F.regexp_replace("field_name", r"^fundamental\.", "").alias("field"), "period", F.col("b.obs_value").alias("value"),
        F.get_json_object("b.record_key", "$.fy").try_cast("int").alias("fy"), F.get_json_object("b.record_key", "$.fp").alias("fp"),
    )


def wide_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_fields(facts(spark, sf_dir), ["asset_id", "frequency", "period"], "field", "value", FIELDS)


def fund_period_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts by period, with the fields that are missing and whether the period is complete."""
    return wide_facts(spark, sf_dir).select("asset_id", "frequency", "period", *FIELDS, F.size("missing").alias("missing"), (F.size("missing") == 0).alias("complete"))


def fund_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(wide_facts(spark, sf_dir).drop("missing", "duplicated"), ["asset_id", "frequency", "period"], CORE)


#: Facts of the catalogue, each made from orders of its own.
_MADE = [
    "revenue", "net_income", "cash", "shares_outstanding", "total_assets", "equity", "gross_profit", "operating_income", "pretax_income", "income_tax", "interest_expense", "operating_cash_flow", "capital_expenditures",
    "current_assets", "current_liabilities", "commercial_paper", "long_term_debt_current", "long_term_debt_noncurrent", "marketable_securities_current", "marketable_securities_noncurrent", "ppe_net",
    "research_and_development", "selling_general_and_administrative", "share_based_compensation", "dividends_paid", "share_repurchases", "diluted_eps", "diluted_shares", "operating_lease_current",
    "operating_lease_noncurrent", "finance_lease_current", "finance_lease_noncurrent",
]
#: A fact's figure: urgent orders count against it, small sums are zero, and where it has no order it is missing.
_FIGURE = "floor(sum(case when o_orderkey % {m} = {k} then case when substr(o_orderpriority, 1, 1) = '1' then -o_totalprice else o_totalprice end end) / 60000) * 60000"


def fund_research(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of the catalogue on figures made from orders, by nation and year; figures are independent of each other and
    may be negative, zero or missing."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    made = [F.expr(_FIGURE.format(m=len(_MADE), k=k)).cast("double").alias(n) for k, n in enumerate(_MADE)]
    base = o.groupBy(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year")).agg(*made)
    return evaluate(base, ["nation", "year"], RATIOS)


def fund_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir).where("fy is not null and fp is not null and frequency = 'annual'")
    out = year_over_year(f, ["asset_id", "field"], "fy", "fp", "value")
    return out.select("asset_id", "field", "fy", F.round("growth", 6).alias("growth"), F.round("change_rate", 6).alias("change_rate"))


def fund_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_statistics(facts(spark, sf_dir).where("frequency = 'annual'"), ["asset_id", "field"], "period", "value")


def fund_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each annual net margin stands among the earlier ones of its asset."""
    m = evaluate(wide_facts(spark, sf_dir).drop("missing", "duplicated").where("frequency = 'annual'"), ["asset_id", "period"], CORE[:1]).where("value is not null")
    return percentile_rank(m, ["asset_id"], "period", "value")


def fund_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst quality and latest availability of each filing's facts."""
    o = table(spark, sf_dir, "observations").where("raw_record_id is not null")
    return o.groupBy("raw_record_id").agg(quality_name(F.max(quality_rank(F.col("quality")))).alias("quality"), F.max("available_at").alias("available_at"), F.count_distinct("observation_id").alias("facts"))


def fund_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of each annual fact: how many, how many superseded, and whether the last ones disagree."""
    o = table(spark, sf_dir, "observations").where("frequency = 'annual' and asset_id is not null and field_name is not null and period_end is not null and available_at is not null and observation_id is not null")
    o = o.select("asset_id", "field_name", F.to_date("period_end").alias("period"), "available_at", "observation_id", "obs_value").distinct()
    out = latest_revision(o, ["asset_id", "field_name", "period"], "available_at", ["obs_value"], "observation_id")
    return out.select("asset_id", "field_name", "period", "observation_id", "ambiguous", "revisions", "superseded")


def fund_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations whose record is not among the raw records, by source."""
    o = table(spark, sf_dir, "observations").select("observation_id", "source_id", "raw_record_id").distinct()
    raw = table(spark, sf_dir, "raw_records").select(F.col("record_id").alias("raw_record_id")).distinct()
    return o.join(raw, "raw_record_id", "left_anti").groupBy("source_id").agg(F.count(F.lit(1)).alias("orphans"))


def macro_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observations of each series, by the first day of the stated period, as the last snapshot before the cut had them."""
    known = table(spark, sf_dir, "macro_vintages").where(F.col("vintage_date") <= F.lit("2020-06-30").cast("date"))
    timed = with_instant(known, "observation_date", "feed", table(spark, sf_dir, "feed_zones"), "ms", period=True).where("ms is not null")
    day = F.date_format(F.date_from_unix_date(F.floor(F.col("ms") / 86_400_000.0).cast("int")), "yyyy-MM-dd")
    m = timed.withColumn("observation_date", day).select("series_id", "observation_date", "vintage_date", "vintage_row_id", "raw_value").distinct()
    out = latest_revision(m, ["series_id", "observation_date"], "vintage_date", ["raw_value"], "vintage_row_id")
    return out.select("series_id", "observation_date", "vintage_date", "vintage_row_id", "ambiguous", "revisions", "superseded")


def cond_tri_valued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three conditions on each complete or incomplete period, and all of them together."""
    w = wide_facts(spark, sf_dir)
    a = outcome(F.try_divide(F.col("net_income"), F.col("revenue")), "gte", 0.1)
    b = outcome(F.try_divide(F.col("total_liabilities"), F.col("total_assets")), "lte", 0.6)
    c = outcome(F.col("shares_outstanding"), "gt", 1_000_000.0)
    return w.select("asset_id", "frequency", "period", a.alias("margin"), b.alias("leverage"), c.alias("shares"), all_met([a, b, c]).alias("together"))


def _volume_evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = ind.relative_volume(bars(spark, sf_dir), KEYS, 20).withColumn("rv", F.round("relative_volume", 6))
    return v.select(F.col("product_id").alias("stream"), F.col("at_us").alias("at"), outcome(F.col("rv"), "gte", 1.5).alias("entry"), outcome(F.col("rv"), "gte", 1.2).alias("hold"))


def cond_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of high relative volume: opened at 1.5 after two confirmations, held down to 1.2, an hour's cooldown."""
    return fold(_volume_evaluations(spark, sf_dir), 2, 3_600_000_000).select(F.col("stream").alias("product_id"), F.col("at").alias("at_us"), "event")


def cond_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often that condition matched, opened and closed in the past of each product."""
    return replay(_volume_evaluations(spark, sf_dir), 2, 3_600_000_000).withColumnRenamed("stream", "product_id")


def cond_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fold(_volume_evaluations(spark, sf_dir), 2, 3_600_000_000)
    return transitions(events).withColumnRenamed("stream", "product_id")


def cond_json_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose properties hold a given parameter."""
    e = table(spark, sf_dir, "events").where(F.get_json_object("props", "$.k").try_cast("int") == 20)
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, close_price): the last valid bar up to the valuation date, as known by then.

    Bars are dated by the New York day of t, and of a day's bars the one known last counts. The symbol of an asset is 'Q'
    and its short name.
    """
    bars_ = bars_by_day(spark, sf_dir).where("bar_id is not null and c > 0 and c >= l and c <= h").select(
        F.col("symbol").alias("entity"), F.lit("c").alias("attribute"), F.format_string("%020d", "bar_id").alias("fact_id"), (F.col("day") * F.lit(DAY)).alias("period_end"), F.expr(micros_sql("available_at")).alias("known"), "c"
    )
    asked = table(spark, sf_dir, "valuation_requests").select(
        F.col("request_id").alias("point_id"), F.concat(F.lit("Q"), F.upper(F.regexp_replace("asset_id", "^equity-", ""))).alias("entity"),
        F.datediff("valuation_date", F.lit("1970-01-01").cast("date")).alias("at_day"), F.expr(micros_sql("known_at")).alias("at_micros"),
    ).distinct()
    closes = bars_.groupBy("fact_id").agg(F.max("c").alias("close_price"))
    return locate(asked, rectangles(bars_)).join(closes, "fact_id").select(F.col("point_id").alias("request_id"), "close_price")


def val_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and annual facts of each request that has either, as known by then."""
    found = p1_found(spark, sf_dir)
    values = table(spark, sf_dir, "observations").groupBy("observation_id").agg(F.min(F.struct(F.regexp_replace("field_name", r"^fundamental\.", "").alias("field"), "obs_value")).alias("o"))
    facts_ = found.join(values, "observation_id").select("request_id", "o.field", "o.obs_value")
    wide = pivot_fields(facts_, ["request_id"], "field", "obs_value", FIELDS).drop("missing", "duplicated")
    return _prices(spark, sf_dir).join(wide, "request_id", "full")


def val_multiples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiples at each request that has a price; one without its facts, or over none above zero, is null."""
    asked = table(spark, sf_dir, "valuation_requests").select("request_id", F.concat(F.lit("Q"), F.upper(F.regexp_replace("asset_id", "^equity-", ""))).alias("symbol")).distinct()
    cap = F.col("close_price") * F.col("shares_outstanding")
    over = lambda x: F.when(x > 0, F.round(F.try_divide(cap, x), 4))
    return val_inputs(spark, sf_dir).where("close_price is not null").join(asked, "request_id").select(
        "request_id", "symbol", F.round(cap, 2).alias("market_cap"), over(F.col("net_income")).alias("price_to_earnings"), over(F.col("revenue")).alias("price_to_sales"), over(F.col("total_assets") - F.col("total_liabilities")).alias("price_to_book")
    )


QUERIES = {
    f.__name__: f
    for f in (
        fund_period_view, fund_core, fund_research, fund_yoy, fund_history, fund_percentile, fund_quality, fund_revisions, fund_lineage, macro_as_of,
        cond_tri_valued, cond_lifecycle, cond_replay, cond_transitions, cond_json_parameter, val_multiples,
    )
}

#: The catalogue's formulas once more, for the oracle: metric, numerator, denominator.
_QUOTIENTS = [
    ("asset_turnover", "revenue", "total_assets"), ("capex_to_operating_cash_flow", "capital_expenditures", "operating_cash_flow"), ("cash_ratio", "cash", "current_liabilities"),
    ("current_financial_debt_share", "short_debt", "debt"), ("current_ratio", "current_assets", "current_liabilities"), ("financial_debt_to_assets", "debt", "total_assets"), ("financial_debt_to_equity", "debt", "equity"),
    ("financial_debt_to_free_cash_flow", "debt", "fcf"), ("fixed_asset_turnover", "revenue", "ppe_net"), ("free_cash_flow_margin", "fcf", "revenue"), ("free_cash_flow_per_diluted_share", "fcf", "diluted_shares"),
    ("free_cash_flow_to_net_income", "fcf", "net_income"), ("gross_margin", "gross_profit", "revenue"), ("interest_coverage", "operating_income", "interest_expense"), ("net_debt_to_free_cash_flow", "debt - liquid", "fcf"),
    ("net_margin", "net_income", "revenue"), ("operating_cash_flow_margin", "operating_cash_flow", "revenue"), ("operating_cash_flow_to_net_income", "operating_cash_flow", "net_income"), ("operating_margin", "operating_income", "revenue"),
    ("research_and_development_to_revenue", "research_and_development", "revenue"), ("return_on_assets_ending_balance", "net_income", "total_assets"), ("return_on_equity_ending_balance", "net_income", "equity"),
    ("revenue_per_diluted_share", "revenue", "diluted_shares"), ("selling_general_and_administrative_to_revenue", "selling_general_and_administrative", "revenue"),
    ("share_based_compensation_to_revenue", "share_based_compensation", "revenue"), ("shareholder_distributions_to_free_cash_flow", "paid", "fcf"),
]
_SUMS = [
    ("current_financial_debt", "short_debt"), ("diluted_eps", "diluted_eps"), ("diluted_shares", "diluted_shares"), ("financial_debt", "debt"), ("free_cash_flow", "fcf"), ("lease_liabilities", "leases"), ("net_debt", "debt - liquid"),
    ("net_liquid_assets", "liquid - long_term_debt_current - long_term_debt_noncurrent"), ("shareholder_distributions", "paid"), ("shares_outstanding", "shares_outstanding"), ("total_financial_obligations", "debt + leases"),
    ("working_capital", "current_assets - current_liabilities"),
]
_CASE = "case when {v} is null then 'not_evaluable' when {v} {op} {t} then 'met' else 'not_met' end"
_TRI = {
    "margin": _CASE.format(v="(net_income / nullif(revenue, 0))", op=">=", t=0.1),
    "leverage": _CASE.format(v="(total_liabilities / nullif(total_assets, 0))", op="<=", t=0.6),
    "shares": _CASE.format(v="shares_outstanding", op=">", t=1000000),
}
_LIFECYCLE = _RBARS + f""", rv as (select product_id, at_us, row_number() over (partition by product_id order by at_us) as n, round(volume / b, 6) as v from (select *, avg(volume) {_W.format(a=20, b='1 preceding')} as b from bars) x where rn >= 20 and b <> 0),
        s as (select product_id, at_us, n, case when v >= 1.5 then 1 else 0 end as cnt, false as is_open, cast(null as bigint) as until, cast(null as varchar) as event from rv where n = 1
        union all select r.product_id, r.at_us, r.n,
          case when s.is_open then case when r.v < 1.2 then 0 else s.cnt end when r.v >= 1.5 then s.cnt + 1 else 0 end,
          case when s.is_open then r.v >= 1.2 else r.v >= 1.5 and s.cnt + 1 >= 2 and (s.until is null or r.at_us >= s.until) end,
          case when not s.is_open and r.v >= 1.5 and s.cnt + 1 >= 2 and (s.until is null or r.at_us >= s.until) then r.at_us + 3600000000 else s.until end,
          case when s.is_open then case when r.v < 1.2 then 'closed' end when r.v >= 1.5 and s.cnt + 1 >= 2 and (s.until is null or r.at_us >= s.until) then 'opened' end
        from s join rv r on r.product_id = s.product_id and r.n = s.n + 1)"""
SQL = {
    "fund_period_view": _FACTS + """select asset_id, frequency, period, revenue, net_income, total_assets, total_liabilities, shares_outstanding,
        (revenue is null)::int + (net_income is null)::int + (total_assets is null)::int + (total_liabilities is null)::int + (shares_outstanding is null)::int as missing,
        revenue is not null and net_income is not null and total_assets is not null and total_liabilities is not null and shares_outstanding is not null as complete from wide""",
    "fund_core": _FACTS + """, m as (select asset_id, frequency, period, 'net_margin' as metric, net_income as t, revenue as b from wide union all select asset_id, frequency, period, 'liabilities_to_assets', total_liabilities, total_assets from wide
          union all select asset_id, frequency, period, 'liabilities_to_net_assets', total_liabilities, total_assets - total_liabilities from wide)
        select asset_id, frequency, period, metric, case when b > 0 then round(t / b, 6) end as value, case when t is null or b is null then 'missing_inputs' when b <= 0 then 'non_positive_denominator' end as reason from m""",
    "fund_research": f"""with f as (select c_nationkey as nation, year(o_orderdate) as year, {', '.join(f"{_FIGURE.format(m=len(_MADE), k=k)} as {n}" for k, n in enumerate(_MADE))} from orders join customer on c_custkey = o_custkey group by 1, 2),
        g as (select *, operating_cash_flow - capital_expenditures as fcf, commercial_paper + long_term_debt_current as short_debt, commercial_paper + long_term_debt_current + long_term_debt_noncurrent as debt,
          cash + marketable_securities_current + marketable_securities_noncurrent as liquid, operating_lease_current + operating_lease_noncurrent + finance_lease_current + finance_lease_noncurrent as leases, dividends_paid + share_repurchases as paid from f),
        m as (select nation, year, unnest([{', '.join(f"{{'metric': '{n}', 't': {t}, 'b': {b}}}" for n, t, b in _QUOTIENTS)}]) as x from g),
        plain as (select nation, year, unnest([{', '.join(f"{{'metric': '{n}', 't': {t}}}" for n, t in _SUMS)}]) as x from g),
        tax as (select nation, year, 'effective_tax_rate' as metric, income_tax / nullif(pretax_income, 0) as v, case when income_tax is null or pretax_income is null then 'missing_inputs' when pretax_income <= 0 then 'non_positive_denominator'
            when income_tax / pretax_income < 0 or income_tax / pretax_income > 1 then 'tax_rate_out_of_range' end as reason from g
          union all select nation, year, 'return_on_invested_capital_ending_balance', operating_income * (1 - income_tax / nullif(pretax_income, 0)) / nullif(equity + debt - liquid, 0),
            case when operating_income + income_tax + pretax_income + equity + debt + liquid is null then 'missing_inputs' when pretax_income <= 0 then 'non_positive_denominator'
            when income_tax / pretax_income < 0 or income_tax / pretax_income > 1 then 'tax_rate_out_of_range' when equity + debt - liquid <= 0 then 'non_positive_denominator' end from g)
        select nation, year, x.metric as metric, case when x.b > 0 then round(x.t / x.b, 6) end as value, case when x.t is null or x.b is null then 'missing_inputs' when x.b <= 0 then 'non_positive_denominator' end as reason from m
        union all select nation, year, x.metric, round(x.t, 6), case when x.t is null then 'missing_inputs' end from plain
        union all select nation, year, metric, case when reason is null then round(v, 6) end, reason from tax""",
    "fund_yoy": _FACTS + """, one as (select asset_id, field, fy, fp, min(value) as value from f where fy is not null and fp is not null and frequency = 'annual' and value is not null group by 1, 2, 3, 4 having count(*) = 1)
        select a.asset_id, a.field, a.fy, case when b.value > 0 then round(a.value / b.value - 1, 6) end as growth, case when b.value <> 0 then round((a.value - b.value) / abs(b.value), 6) end as change_rate
        from one a join one b on a.asset_id = b.asset_id and a.field = b.field and a.fp = b.fp and a.fy = b.fy + 1""",
    "fund_history": _FACTS + """, z as (select asset_id, field, period, value, row_number() over (partition by asset_id, field order by period desc) as back from f where frequency = 'annual' and value is not null)
        select asset_id, field, round(max(value) - min(value), 4) as value_range, round(arg_max(value, period) - max(value) filter (back = 2), 4) as previous_change, round(arg_max(value, period) - arg_min(value, period), 4) as horizon_change,
        round(case when arg_min(value, period) <> 0 then (arg_max(value, period) - arg_min(value, period)) / abs(arg_min(value, period)) end, 6) as horizon_rate, count(*) as points, arg_min(value, period) as first_value, arg_max(value, period) as last_value, min(value) as least, max(value) as most, round(avg(value), 4) as mean,
        case when arg_min(value, period) > 0 and arg_max(value, period) > 0 and max(period) - min(period) >= 365 then round(pow(arg_max(value, period) / arg_min(value, period), 1.0 / nullif((max(period) - min(period)) / 365.2425, 0)) - 1, 6) end as growth_a_year
        from z group by 1, 2""",
    "fund_percentile": _FACTS + """, m as (select asset_id, period, round(net_income / revenue, 6) as value from wide where frequency = 'annual' and revenue > 0 and net_income is not null)
        select * from (select a.asset_id, a.period, a.value, count(*) as prior, round((count(*) filter (b.value < a.value) + 0.5 * count(*) filter (b.value = a.value)) / count(*), 6) as rank
        from m a join m b on a.asset_id = b.asset_id and b.period < a.period group by 1, 2, 3) x where prior >= 3""",
    "fund_quality": """select raw_record_id, list_extract(['valid', 'delayed', 'partial', 'suspect'], max(case quality when 'valid' then 1 when 'delayed' then 2 when 'partial' then 3 when 'suspect' then 4 end)) as quality,
        max(available_at) as available_at, count(distinct observation_id) as facts from observations where raw_record_id is not null group by 1""",
    "fund_revisions": """with o as (select distinct asset_id, field_name, period_end::date as period, available_at, observation_id, obs_value from observations
        where frequency = 'annual' and asset_id is not null and field_name is not null and period_end is not null and available_at is not null and observation_id is not null),
        m as (select *, max(available_at) over (partition by asset_id, field_name, period) as last, count(*) over (partition by asset_id, field_name, period) as revisions from o)
        select asset_id, field_name, period, min(observation_id) as observation_id, count(distinct coalesce(obs_value::varchar, '')) > 1 as ambiguous, max(revisions) as revisions, max(revisions) - count(*) as superseded
        from m where available_at = last group by 1, 2, 3""",
    "fund_lineage": "select source_id, count(*) as orphans from (select distinct observation_id, source_id, raw_record_id from observations) o where not exists (select 1 from raw_records r where r.record_id = o.raw_record_id) group by 1",
    "macro_as_of": "with " + instants("i", "select distinct vintage_row_id as id, observation_date as t, feed from macro_vintages", True) + """,
        o as (select distinct series_id, make_timestamp(i.ms * 1000)::date as day, vintage_date, vintage_row_id, raw_value from macro_vintages v join i on i.id = v.vintage_row_id where i.ms is not null and vintage_date <= date '2020-06-30'),
        m as (select *, max(vintage_date) over (partition by series_id, day) as last, count(*) over (partition by series_id, day) as revisions from o)
        select series_id, strftime(day, '%Y-%m-%d') as observation_date, last as vintage_date, min(vintage_row_id) as vintage_row_id, count(distinct coalesce(raw_value, '~')) > 1 as ambiguous, max(revisions) as revisions, max(revisions) - count(*) as superseded
        from m where vintage_date = last group by series_id, day, last""",
    "cond_tri_valued": _FACTS + f"""select asset_id, frequency, period, margin, leverage, shares, case when margin = 'met' and leverage = 'met' and shares = 'met' then 'met'
        when 'not_met' in (margin, leverage, shares) then 'not_met' else 'not_evaluable' end as together from (select *, {', '.join(f'{v} as {k}' for k, v in _TRI.items())} from wide) t""",
    "cond_lifecycle": _LIFECYCLE + " select product_id, at_us, event from s where event is not null",
    "cond_replay": _LIFECYCLE + """ select product_id, count(*) as evaluations, count(*) filter (v >= 1.5) as matched, 0 as not_evaluable, min(at_us) as first_at, max(at_us) as last_at, round(count(*) filter (v >= 1.5) / count(*), 6) as match_rate,
        count(*) filter (event = 'opened') as opened, count(*) filter (event = 'closed') as closed from s join rv using (product_id, at_us) group by 1""",
    "cond_transitions": _LIFECYCLE + """, e as (select product_id, at_us, event, lead(at_us) over (partition by product_id order by at_us) as next from s where event is not null)
        select product_id, at_us as opened_at, next as closed_at from e where event = 'opened'""",
    "val_multiples": f"""with {BARS_BY_DAY},
        q as (select distinct request_id, 'Q' || upper(regexp_replace(asset_id, '^equity-', '')) as symbol, known_at, valuation_date, asset_id from valuation_requests where asset_id is not null and known_at is not null and valuation_date is not null and request_id is not null),
        p as (select q.*, b.c from q join bars_by_day b on q.symbol = b.symbol and b.available_at <= q.known_at and b.day <= q.valuation_date where b.c > 0 and b.c >= b.l and b.c <= b.h and b.bar_id is not null
          qualify row_number() over (partition by request_id order by b.day desc, b.available_at desc, b.bar_id) = 1),
        k as (select q.request_id, replace(o.field_name, 'fundamental.', '') as field, o.obs_value, row_number() over (partition by q.request_id, o.field_name order by o.period_end desc, o.available_at desc, o.observation_id) as k
          from q join (select distinct * from observations) o on o.asset_id = q.asset_id and o.available_at <= q.known_at and o.period_end::date <= q.valuation_date where o.frequency = 'annual' and o.quality = 'valid'),
        w as (select request_id, max(obs_value) filter (field = 'revenue') as revenue, max(obs_value) filter (field = 'net_income') as net_income, max(obs_value) filter (field = 'total_assets') - max(obs_value) filter (field = 'total_liabilities') as book,
          max(obs_value) filter (field = 'shares_outstanding') as shares from k where k = 1 group by 1)
        select p.request_id, p.symbol, round(c * shares, 2) as market_cap, case when net_income > 0 then round(c * shares / net_income, 4) end as price_to_earnings, case when revenue > 0 then round(c * shares / revenue, 4) end as price_to_sales,
          case when book > 0 then round(c * shares / book, 4) end as price_to_book from p left join w on p.request_id = w.request_id""",
    "cond_json_parameter": "select event_type, count(*) as n, round(sum(value), 4) as total from events where try_cast(json_extract_string(props, '$.k') as int) = 20 group by 1",
}
