"""Valuation, readings of markets and companies, and charts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.operators import indicators as ind
from pitspark.operators.diagnostics import FUNDAMENTAL, fundamental_reading, growth_class, market_reading
from pitspark.operators.ordered import frame, index_rows, rolling
from pitspark.operators.valuation import percentile_rule, valuation_history, valuation_metrics, valuation_status
from pitspark.plans.fundamentals import _FACTS, FACTS_KNOWN_AT, facts, val_inputs, wide_facts
from pitspark.plans.market import _BARS, _W, DAY, KEYS, _calendar, bars
from pitspark.plans.series import BARS_BY_DAY
from pitspark.session import table


def val_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of every request that has a price or facts, with the reason where one has no value."""
    return valuation_metrics(val_inputs(spark, sf_dir), ["request_id"])


def val_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuation_status(val_metrics(spark, sf_dir), ["request_id"])


def _val_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "valuation_requests").where("request_id is not null and asset_id is not null").select("request_id", "asset_id", "valuation_date", "known_at").distinct()
    return val_metrics(spark, sf_dir).where("status = 'evaluated'").join(asked, "request_id")


def val_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of each asset's metrics over the dates asked for; of a date's values that known last counts."""
    return valuation_history(_val_points(spark, sf_dir), ["asset_id", "metric"], "valuation_date", "known_at", "value", 4)


def val_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each asset's price to sales stands in the lowest quarter of its own history."""
    history = val_history(spark, sf_dir).where("metric = 'price_to_sales_latest_annual'")
    return percentile_rule(history, "at_or_below", 0.25, 4).select("asset_id", "points", "rank", "outcome")


def diag_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading of each product's last bar. Its quality is valid if the last 21 bars have no gap; products with fewer bars
    have insufficient data."""
    b = bars(spark, sf_dir)
    prev = F.lag("close").over(frame(KEYS))
    moved = rolling(b, KEYS, 1, {"ret": F.try_divide(F.col("close"), prev) - 1})
    full = lambda n, x: F.when(F.col("rn") >= n, x)
    w = rolling(moved, KEYS, 20, {
        "short": full(4, F.avg("close").over(frame(KEYS, -4))), "long": full(19, F.avg("close").over(frame(KEYS, -19))), "volatility": full(20, F.stddev_samp("ret").over(frame(KEYS, -19))),
        "base": full(20, F.avg("volume").over(frame(KEYS, -20, -1))), "since": F.lag("at_us", 20).over(frame(KEYS)),
    })
    whole = F.when(F.col("at_us") - F.col("since") == 20 * F.col("granularity_s") * F.lit(1_000_000).cast("long"), "valid").otherwise("partial")
    own = w.withColumns({"relative_volume": F.when(F.col("base") != 0, F.col("volume") / F.col("base")), "quality": whole})
    last = own.groupBy("product_id").agg(F.max(F.struct("rn", "at_us", "short", "long", "ret", "volatility", "relative_volume", "quality")).alias("x"))
    return market_reading(last.select("product_id", "x.*"), ["product_id", "at_us"])


def diag_fundamental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading of each asset's last period of either frequency, as known at the cut."""
    f = facts(spark, sf_dir).where("frequency in ('annual', 'quarterly')")
    keys = ["asset_id", "frequency"]
    sums = lambda name: F.max(F.when(F.col("field") == name, F.col("value")))
    w = f.groupBy(*keys, "period").agg(
        sums("revenue").alias("revenue"), sums("net_income").alias("net_income"), sums("total_assets").alias("assets"), sums("total_liabilities").alias("liabilities"), F.max("available_at").alias("seen"), F.max("fy").alias("fy"), F.max("fp").alias("fp"),
    )
    last = w.groupBy(*keys).agg(F.max(F.struct("period", "revenue", "net_income", "assets", "liabilities", "seen", "fy", "fp")).alias("x")).select(*keys, "x.*")
    before = w.where("fy is not null and fp is not null").groupBy(*keys, (F.col("fy") + 1).alias("fy"), "fp").agg(F.max(F.struct("period", "revenue", "net_income")).alias("b"))
    both = last.join(before, [*keys, "fy", "fp"], "left")
    positive = lambda a, b: F.when(b > 0, a / b)
    m = both.select(
        *keys, "period", positive(F.col("net_income"), F.col("revenue")).alias("net_margin"), positive(F.col("liabilities"), F.col("assets")).alias("liabilities_to_assets"),
        positive(F.col("liabilities"), F.col("assets") - F.col("liabilities")).alias("liabilities_to_equity"), (positive(F.col("revenue"), F.col("b.revenue")) - 1).alias("revenue_yoy_growth"),
        F.when(F.col("b.net_income") != 0, (F.col("net_income") - F.col("b.net_income")) / F.abs("b.net_income")).alias("net_income_yoy_change_rate"),
        F.datediff(F.lit(FACTS_KNOWN_AT).cast("date"), F.col("seen").cast("date")).alias("age_days"),
    )
    return fundamental_reading(m, [*keys, "period"], "frequency", "age_days")


def fund_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth classes by the last five annual earnings and revenues a share, over three years at least."""
    w = wide_facts(spark, sf_dir).where("frequency = 'annual' and shares_outstanding > 0").select("asset_id", "period", (F.col("net_income") / F.col("shares_outstanding")).alias("eps"), (F.col("revenue") / F.col("shares_outstanding")).alias("rps"))
    out = None
    for name in ("eps", "rps"):
        p = w.where(F.col(name).isNotNull()).groupBy("asset_id").agg(F.slice(F.sort_array(F.collect_list(F.struct("period", name)), False), 1, 5).alias("p"))
        first, last = F.element_at("p", -1), F.element_at("p", 1)
        days = F.datediff(last["period"], first["period"])
        grown = F.when((F.size("p") >= 4) & (days >= 365 * 3) & (first[name] > 0) & (last[name] > 0), F.pow(last[name] / first[name], 365.2425 / days) - 1)
        own = p.select("asset_id", F.round(grown, 6).alias(f"{name}_growth"), F.size("p").cast("long").alias(f"{name}_points"))
        out = own if out is None else out.join(own, "asset_id", "full")
    status = F.when(F.col("eps_growth").isNull() | F.col("rps_growth").isNull(), "insufficient_evidence").when(growth_class(F.col("eps_growth"), F.col("rps_growth")).isNull(), "unclassified").otherwise("classified")
    return out.withColumns({"status": status, "category": growth_class(F.col("eps_growth"), F.col("rps_growth"))})


def chart_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over 3, 5 and 10 daily closes and bands around that over 5; flat bands keep their row."""
    days = _calendar(spark, sf_dir, "day").select("product_id", "bucket", F.datediff("bucket", F.lit("1970-01-01").cast("date")).alias("day"), "close")
    d = index_rows(days, KEYS, "day", 365)
    full = lambda n, x: F.when(F.col("rn") >= n - 1, x)
    means = {f"sma_{n}": full(n, F.avg("close").over(frame(KEYS, -(n - 1)))) for n in (3, 5, 10)}
    w = rolling(d, KEYS, 9, {**means, "dev": full(5, F.stddev_pop("close").over(frame(KEYS, -4)))})
    r = lambda c: F.round(c, 4)
    return w.select("product_id", "bucket", *[r(F.col(n)).alias(n) for n in means], r(F.col("sma_5") + 2 * F.col("dev")).alias("upper"), r(F.col("sma_5") - 2 * F.col("dev")).alias("lower"))


def chart_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth a year over each product's bars, the deepest fall, and the moments of its peak and trough."""
    d = ind.drawdown(bars(spark, sf_dir), KEYS)
    # of equal falls the first; the peak it fell from is the last one at or before the trough
    low = d.groupBy("product_id").agg(F.min(F.struct("drawdown", "at_us", "peak")).alias("t"), F.min_by("close", "at_us").alias("first"), F.max_by("close", "at_us").alias("last"), F.min("at_us").alias("a"), F.max("at_us").alias("b"))
    top = d.select("product_id", "at_us", "close").join(low.select("product_id", F.col("t.at_us").alias("trough"), F.col("t.peak").alias("p")), "product_id").where("close = p and at_us <= trough").groupBy("product_id").agg(F.max("at_us").alias("peak_us"))
    years = (F.col("b") - F.col("a")) / F.lit(365.2425 * DAY)
    return low.join(top, "product_id").select("product_id", F.round(F.when(years * 365.2425 >= 1, F.pow(F.col("last") / F.col("first"), 1 / years) - 1), 4).alias("growth_a_year"), F.round("t.drawdown", 6).alias("max_drawdown"), "peak_us", F.col("t.at_us").alias("trough_us"))


def der_dvol_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the volatility index over 1, 7 and 30 days, where every day between has a close; of a day's revisions the
    one delivered last, none where those delivered together disagree."""
    from pitspark.operators.pit import latest_revision
    from pitspark.operators.shred import shred, table_of
    from pitspark.session import numbered

    r = numbered(spark, sf_dir, "raw_records", "record_id", "asset_id", "source_id", "available_at", "payload").where("source_id = 'deribit-dvol'")
    seen = r.where("record_id is not null").groupBy("record_id").agg(F.min("asset_id").alias("asset_id"), F.min("available_at").alias("available_at"))
    p = table_of(shred(r), "point").where("epoch_ms is not null and close is not null").select("record_id", "epoch_ms", "close", "node_key")
    own = p.join(seen, "record_id").where("asset_id is not null").select("asset_id", F.floor(F.col("epoch_ms") / F.lit(86_400_000.0)).cast("long").alias("day"), "available_at", "node_key", "close")
    days = index_rows(latest_revision(own, ["asset_id", "day"], "available_at", ["close"], "node_key").where("not ambiguous").select("asset_id", "day", "close"), ["asset_id"], "day", 365)
    out = [ind.lagged_change(days, ["asset_id"], k, "close", "day").select("asset_id", "day", F.lit(k).alias("days"), F.round("change", 4).alias("change")) for k in (1, 7, 30)]
    return out[0].unionAll(out[1]).unionAll(out[2])


QUERIES = {f.__name__: f for f in (val_metrics, val_status, val_history, val_rule, diag_market, diag_fundamental, fund_class, chart_daily, chart_range, der_dvol_days)}

_VAL = f"""with {BARS_BY_DAY},
    q as (select distinct request_id, 'Q' || upper(regexp_replace(asset_id, '^equity-', '')) as symbol, known_at, valuation_date, asset_id from valuation_requests where asset_id is not null and known_at is not null and valuation_date is not null and request_id is not null),
    p as (select q.request_id, b.c from q join bars_by_day b on q.symbol = b.symbol and b.available_at <= q.known_at and b.day <= q.valuation_date where b.c > 0 and b.c >= b.l and b.c <= b.h and b.bar_id is not null
      qualify row_number() over (partition by request_id order by b.day desc, b.available_at desc, b.bar_id) = 1),
    k as (select q.request_id, replace(o.field_name, 'fundamental.', '') as field, o.obs_value from q join (select distinct * from observations) o on o.asset_id = q.asset_id and o.available_at <= q.known_at and o.period_end::date <= q.valuation_date
      where o.frequency = 'annual' and o.quality = 'valid' and o.observation_id is not null and o.field_name is not null qualify row_number() over (partition by q.request_id, o.field_name order by o.period_end desc, o.available_at desc, o.observation_id) = 1),
    w as (select request_id, max(obs_value) filter (field = 'revenue') as revenue, max(obs_value) filter (field = 'net_income') as net_income, max(obs_value) filter (field = 'shares_outstanding') as shares from k group by 1),
    x as (select coalesce(p.request_id, w.request_id) as request_id, c, shares, c * shares as cap, revenue, net_income from p full join w on p.request_id = w.request_id),
    m as (select request_id, 'market_cap' as metric, cap as v, case when c is null or shares is null then 'missing_input' when c <= 0 or shares <= 0 then 'invalid_denominator' end as reason from x
      union all select request_id, 'price_to_earnings_latest_annual', cap / net_income, case when c is null or shares is null or net_income is null then 'missing_input' when c <= 0 or shares <= 0 or net_income <= 0 then 'invalid_denominator' end from x
      union all select request_id, 'price_to_sales_latest_annual', cap / revenue, case when c is null or shares is null or revenue is null then 'missing_input' when c <= 0 or shares <= 0 or revenue <= 0 then 'invalid_denominator' end from x
      union all select request_id, 'earnings_yield_latest_annual', net_income / cap, case when c is null or shares is null or net_income is null then 'missing_input' when c <= 0 or shares <= 0 then 'invalid_denominator' end from x
      union all select request_id, unnest(['financial_debt', 'enterprise_value', 'price_to_book', 'enterprise_value_to_sales_latest_annual', 'enterprise_value_to_ebit_latest_annual', 'free_cash_flow_yield_latest_annual']), null, 'missing_input' from x
      union all select request_id, 'enterprise_value_to_ebitda_latest_annual', null, 'ebitda_unavailable' from x),
    metrics as (select request_id, metric, case when reason is null then round(v, 6) end as value, case when reason is null then 'evaluated' else 'not_evaluable' end as status, reason from m)"""
_HISTORY = _VAL + """, pts as (select r.asset_id, metric, valuation_date, known_at, value from metrics m join (select distinct request_id, asset_id, valuation_date, known_at from valuation_requests) r on m.request_id = r.request_id where status = 'evaluated'),
    ld as (select *, max(known_at) over (partition by asset_id, metric, valuation_date) as last, count(*) over (partition by asset_id, metric, valuation_date) as n from pts),
    one as (select asset_id, metric, valuation_date, min(value) as v, min(value) <> max(value) as ambiguous, max(n) - 1 as superseded from ld where known_at = last group by 1, 2, 3),
    fine as (select *, row_number() over (partition by asset_id, metric order by valuation_date) as k, count(*) over (partition by asset_id, metric) as total from one where not ambiguous),
    ends as (select asset_id, metric, arg_max(v, valuation_date) as last_value from fine group by 1, 2),
    history as (select f.asset_id, f.metric, count(*) as points, arg_min(v, valuation_date) as first_value, any_value(last_value) as last_value, min(v) as least, max(v) as most, round(avg(v), 4) as mean, round(max(v) - min(v), 4) as value_range,
      case when count(*) > 1 then round(any_value(last_value) - max(v) filter (k = total - 1), 4) end as previous_change, case when count(*) > 1 then round(any_value(last_value) - arg_min(v, valuation_date), 4) end as horizon_change,
      case when count(*) > 1 then round((count(*) filter (v < last_value and k < total) + 0.5 * count(*) filter (v = last_value and k < total)) / (count(*) - 1), 4) end as rank,
      (select count(*) from one o where o.asset_id = f.asset_id and o.metric = f.metric and ambiguous) as ambiguous, (select sum(superseded)::bigint from one o where o.asset_id = f.asset_id and o.metric = f.metric) as superseded
      from fine f join ends e on f.asset_id = e.asset_id and f.metric = e.metric group by 1, 2)"""
_CL = "least(greatest({0}, 0.0), 100.0)"
_READ = ", ".join(f"{_CL.format(f'({n} - ({z})) / ({f} - ({z})) * 100')} as s{k}" for k, (n, _, z, f) in enumerate(FUNDAMENTAL))
_SUM = " + ".join(f"coalesce(case when {n} is not null then s{k} end * {w}, 0)" for k, (n, w, *_) in enumerate(FUNDAMENTAL))
_COVER = " + ".join(f"case when {n} is null then 0.0 else {w} end" for n, w, *_ in FUNDAMENTAL)
SQL = {
    "val_metrics": _VAL + " select * from metrics",
    "val_status": _VAL + """ select request_id, count(*) as total, count(*) filter (status = 'evaluated') as evaluated,
        case when count(*) filter (status = 'evaluated') = count(*) then 'evaluated' when count(*) filter (status = 'evaluated') > 0 then 'partial' else 'not_evaluable' end as status from metrics group by 1""",
    "val_history": _HISTORY + " select * from history",
    "val_rule": _HISTORY + " select asset_id, points, rank, case when points < 4 or rank is null then 'not_evaluable' when rank <= 0.25 then 'met' else 'not_met' end as outcome from history where metric = 'price_to_sales_latest_annual'",
    "diag_market": _BARS + f""", r as (select *, close / lag(close) over (partition by product_id order by rn) - 1 as ret, max(rn) over (partition by product_id) as last from bars),
        t as (select *, case when rn >= 4 then avg(close) {_W.format(a=4, b='current row')} end as short, case when rn >= 19 then avg(close) {_W.format(a=19, b='current row')} end as long, case when rn >= 20 then stddev_samp(ret) {_W.format(a=19, b='current row')} end as vol,
          case when rn >= 20 then avg(volume) {_W.format(a=20, b='1 preceding')} end as base, lag(at_us, 20) over (partition by product_id order by rn) as since from r),
        x as (select *, volume / nullif(base, 0) as rv, case when at_us - since = 20 * granularity_s::bigint * 1000000 then 'valid' else 'partial' end as quality, short / long - 1 as spread from t where rn = last),
        y as (select *, concat_ws(',', case when short is null then 'short' end, case when long is null then 'long' end, case when ret is null then 'ret' end, case when vol is null then 'volatility' end, case when rv is null then 'relative_volume' end) as missing,
          {_CL.format('50 + 1000 * spread')} as trend, {_CL.format('50 + 1000 * ret')} as momentum from x),
        z as (select *, 0.6 * trend + 0.4 * momentum as s, missing = '' as whole from y)
        select product_id, at_us, case when whole then round(trend, 4) end as trend, case when whole then round(momentum, 4) end as momentum, case when whole then round(s, 4) else 0.0 end as score,
          case when not whole then 'insufficient_data' when round(s, 9) >= 60 then 'positive' when round(s, 9) <= 40 then 'negative' else 'neutral' end as verdict,
          case when whole then round(least((least(greatest(rv / 2, 0), 1) + least(greatest(1 - vol / 0.10, 0), 1)) / 2, case quality when 'valid' then 1.0 else 0.75 end), 4) else 0.0 end as confidence,
          case when whole then round(least(greatest(spread / 0.05, -1), 1), 4) end as trend_signal, case when whole then round(least(greatest(ret / 0.05, -1), 1), 4) end as momentum_signal, quality, missing from z""",
    "diag_fundamental": _FACTS + f""", own as (select asset_id, frequency, period, max(value) filter (field = 'revenue') as revenue, max(value) filter (field = 'net_income') as net_income, max(value) filter (field = 'total_assets') as assets, max(value) filter (field = 'total_liabilities') as liabilities,
          max(available_at) as seen, max(fy) as fy, max(fp) as fp from f where frequency in ('annual', 'quarterly') group by 1, 2, 3),
        lst as (select * from own qualify row_number() over (partition by asset_id, frequency order by period desc) = 1),
        bef as (select * from own where fy is not null and fp is not null qualify row_number() over (partition by asset_id, frequency, fy, fp order by period desc) = 1),
        m as (select l.asset_id, l.frequency, l.period, case when l.revenue > 0 then l.net_income / l.revenue end as net_margin, case when l.assets > 0 then l.liabilities / l.assets end as liabilities_to_assets,
          case when l.assets - l.liabilities > 0 then l.liabilities / (l.assets - l.liabilities) end as liabilities_to_equity, case when b.revenue > 0 then l.revenue / b.revenue - 1 end as revenue_yoy_growth,
          case when b.net_income <> 0 then (l.net_income - b.net_income) / abs(b.net_income) end as net_income_yoy_change_rate, datediff('day', l.seen::date, date '{FACTS_KNOWN_AT[:10]}') as age
          from lst l left join bef b on l.asset_id = b.asset_id and l.frequency = b.frequency and l.fy = b.fy + 1 and l.fp = b.fp),
        s as (select *, {_READ}, round({_COVER}, 9) as coverage, 1 - 0.5 * least(greatest(case frequency when 'annual' then (age - 400) / 400.0 else (age - 150) / 215.0 end, 0), 1) as recency from m),
        e as (select *, net_margin is not null and liabilities_to_assets is not null and coverage >= 0.6 as enough, round(({_SUM}) / nullif(coverage, 0), 6) as sc from s)
        select asset_id, frequency, period, case when enough then round(sc, 4) else 0.0 end as score, round(coverage, 4)::double as coverage, round(recency, 4) as recency, case when enough then round(coverage * recency, 4) else 0.0 end as confidence,
          case when not enough then 'insufficient_data' when sc >= 65 then 'positive' when sc < 40 then 'negative' else 'neutral' end as verdict, case when enough and coverage = 1 and recency >= 0.75 then 'valid' else 'partial' end as quality from e""",
    "fund_class": _FACTS + """, v as (select asset_id, period, net_income / shares_outstanding as eps, revenue / shares_outstanding as rps from wide where frequency = 'annual' and shares_outstanding > 0),
        l as (select asset_id, 'eps' as name, period, eps as x from v where eps is not null union all select asset_id, 'rps', period, rps from v where rps is not null),
        five as (select * from l qualify row_number() over (partition by asset_id, name order by period desc) <= 5),
        g as (select asset_id, name, count(*) as n, case when count(*) >= 4 and max(period) - min(period) >= 1095 and arg_min(x, period) > 0 and arg_max(x, period) > 0 then round(pow(arg_max(x, period) / arg_min(x, period), 365.2425 / (max(period) - min(period))) - 1, 6) end as grown from five group by 1, 2),
        w as (select asset_id, max(grown) filter (name = 'eps') as e, max(n) filter (name = 'eps') as en, max(grown) filter (name = 'rps') as r, max(n) filter (name = 'rps') as rn from g group by 1),
        c as (select *, case when e >= 0 and e < 0.10 and r >= 0 and r < 0.10 then 'slow_grower' when e >= 0.10 and e < 0.20 and r >= 0.05 and r < 0.20 then 'stalwart' when e >= 0.20 and r >= 0.10 then 'fast_grower' end as category from w)
        select asset_id, e as eps_growth, en as eps_points, r as rps_growth, rn as rps_points, case when e is null or r is null then 'insufficient_evidence' when category is null then 'unclassified' else 'classified' end as status, category from c""",
    "chart_daily": _BARS + """, d as (select product_id, make_timestamp(at_us)::date as bucket, arg_max(close, at_us) as close from bars group by 1, 2), n as (select *, row_number() over (partition by product_id order by bucket) as k from d),
        w as (select product_id, bucket, case when k >= 3 then avg(close) over (partition by product_id order by bucket rows 2 preceding) end as a, case when k >= 5 then avg(close) over (partition by product_id order by bucket rows 4 preceding) end as b,
          case when k >= 10 then avg(close) over (partition by product_id order by bucket rows 9 preceding) end as c, case when k >= 5 then stddev_pop(close) over (partition by product_id order by bucket rows 4 preceding) end as dev from n)
        select product_id, bucket, round(a, 4) as sma_3, round(b, 4) as sma_5, round(c, 4) as sma_10, round(b + 2 * dev, 4) as upper, round(b - 2 * dev, 4) as lower from w""",
    "chart_range": _BARS + """, p as (select *, max(close) over (partition by product_id order by rn) as peak from bars), t as (select product_id, at_us as trough, peak, close / peak - 1 as fall from p qualify row_number() over (partition by product_id order by close / peak - 1, at_us) = 1),
        e as (select product_id, arg_min(close, at_us) as first, arg_max(close, at_us) as last, (max(at_us) - min(at_us)) / (365.2425 * 86400000000) as years from bars group by 1)
        select t.product_id, round(case when years * 365.2425 >= 1 then pow(last / first, 1 / years) - 1 end, 4) as growth_a_year, round(fall, 6) as max_drawdown, (select max(at_us) from bars b where b.product_id = t.product_id and b.close = t.peak and b.at_us <= t.trough) as peak_us, trough as trough_us
        from t join e on t.product_id = e.product_id""",
}
