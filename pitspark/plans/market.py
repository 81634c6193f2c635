"""Queries over price bars built from spot_candles: revisions, resampling, indicators, comparison, derivatives windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.operators import indicators as ind
from pitspark.operators.bars import INTERVALS, calendar_bucket, fixed_bucket, is_closed, is_valid_bar, merged_intervals, pivot_fields, resample, unpivot_fields
from pitspark.operators.compare import aligned, pair_statistics, range_statistics
from pitspark.operators.normalise_times import with_instant
from pitspark.operators.ordered import index_rows
from pitspark.operators.pit import best_known, effective_cut, eligible, latest_revision
from pitspark.plans.instant_sql import instants
from pitspark.plans.series import BARS_BY_DAY, bars_by_day
from pitspark.session import micros_sql, table

DAY = 86_400_000_000
KEYS = ["product_id"]
#: The cut at which the point-in-time queries look.
KNOWN_AT = "2025-11-15 00:00:00"
#: Two products that all of the test tables have.
COMPARED = ["ZZQKX-USD", "ZCCFX-USD"]

_MEANING = ["granularity_s", "open", "high", "low", "close", "volume"]
_BARS = f"""
with k as (
  select distinct product_id, granularity_s, epoch_us(candle_start) as at_us, available_at, candle_id, open_price as open, high, low, close_price as close, volume
  from spot_candles where product_id is not null and candle_start is not null and candle_id is not null and available_at <= timestamp '{KNOWN_AT}'),
lasting as (select *, concat_ws('|', {', '.join(f"coalesce({c}::varchar, '~')" for c in _MEANING)}) as m, max(available_at) over (partition by product_id, at_us) as last from k),
c as (select *, row_number() over w as k, min(m) over v as m0, max(m) over v as m1 from lasting where available_at = last
  window w as (partition by product_id, at_us order by candle_id), v as (partition by product_id, at_us)),
versions as (select product_id, granularity_s, at_us, open, high, low, close, volume, m0 <> m1 as ambiguous,
  coalesce(low > 0 and low <= open and open <= high and low <= close and close <= high and volume >= 0, false) as valid from c where k = 1),
bars as (select product_id, granularity_s, at_us, open, high, low, close, volume, row_number() over (partition by product_id order by at_us) - 1 as rn from versions where valid and not ambiguous)
"""
_RBARS = _BARS.replace("with k", "with recursive k", 1)


def versions(spark: SparkSession, sf_dir: str, known_at: str = KNOWN_AT) -> DataFrame:
    """Each candle as it was known at the cut: of its revisions available by then the latest.

    Whether it is usable is asked of that revision alone: an invalid correction hides the older one. Revisions available
    at the same moment that disagree are ambiguous.
    """
    c = table(spark, sf_dir, "spot_candles").where("product_id is not null and candle_start is not null and candle_id is not null").select(
        "product_id", "granularity_s", F.expr(micros_sql("candle_start")).alias("at_us"), F.col("open_price").alias("open"), "high", "low", F.col("close_price").alias("close"), "volume", "available_at", "candle_id"
    )
    known = eligible(c, F.lit(known_at).cast("timestamp_ntz"))
    return latest_revision(known, ["product_id", "at_us"], "available_at", _MEANING, "candle_id").withColumn("valid", is_valid_bar())


def revised(spark: SparkSession, sf_dir: str, known_at: str = KNOWN_AT) -> DataFrame:
    """The usable candles as known at the cut: product_id, granularity_s, at_us (microseconds), open, high, low, close, volume."""
    return versions(spark, sf_dir, known_at).where("valid and not ambiguous").select("product_id", "at_us", *_MEANING)


def bars_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candles of each product were usable, invalid or ambiguous at the cut."""
    n = lambda test: F.count(F.when(F.expr(test), F.lit(1)))
    return versions(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("candles"), n("valid and not ambiguous").alias("usable"), n("not valid and not ambiguous").alias("invalid"), n("ambiguous").alias("ambiguous"))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_rows(revised(spark, sf_dir), KEYS, "at_us", DAY)


def _r(*names: str, places: int = 6) -> list:
    return [F.round(n, places).alias(n) for n in names]


def ind_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.simple_return(bars(spark, sf_dir), KEYS).where("ret is not null").select("product_id", "at_us", *_r("ret"))


def ind_sma_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.sma(bars(spark, sf_dir), KEYS, 20).select("product_id", "at_us", *_r("sma"))


def ind_volatility_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.volatility(bars(spark, sf_dir), KEYS, 20).select("product_id", "at_us", *_r("volatility"))


def ind_relative_volume_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.relative_volume(bars(spark, sf_dir), KEYS, 20).select("product_id", "at_us", *_r("relative_volume", places=4))


def ind_bollinger_20_2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.bollinger(bars(spark, sf_dir), KEYS, 20, 2.0).select("product_id", "at_us", *_r("upper", "lower", "bandwidth", "percent_b", places=4))


def ind_true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.true_range(bars(spark, sf_dir), KEYS).select("product_id", "at_us", *_r("true_range", places=4))


def ind_ema_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.ema(bars(spark, sf_dir), KEYS, 20).select("product_id", "at_us", *_r("ema", places=4))


def ind_rsi_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.rsi(bars(spark, sf_dir), KEYS, 14).select("product_id", "at_us", *_r("rsi", places=4))


def ind_atr_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.atr(bars(spark, sf_dir), KEYS, 14).select("product_id", "at_us", *_r("atr", places=4))


def ind_macd_12_26_9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.macd(bars(spark, sf_dir), KEYS).select("product_id", "at_us", *_r("line", "signal", "histogram", places=4))


def ind_drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.drawdown(bars(spark, sf_dir), KEYS).select("product_id", "at_us", *_r("peak", "drawdown"))


def ind_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes with the first one as 100."""
    b = revised(spark, sf_dir)
    first = b.groupBy("product_id").agg(F.min(F.struct("at_us", "close")).alias("f"))
    return b.join(first, "product_id").select("product_id", "at_us", F.round(100 * F.col("close") / F.col("f.close"), 4).alias("normalised"))


def ind_warm_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each indicator skips before its first value."""
    n = revised(spark, sf_dir).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))
    skips = {"sma_20": 19, "volatility_20": 20, "relative_volume_20": 20, "rsi_14": 14, "atr_14": 13, "macd_12_26_9": 33}
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("indicator"), F.lit(v).alias("need")) for k, v in skips.items()])).alias("s")
    return n.select("product_id", "n", one).select("product_id", F.col("s.indicator").alias("indicator"), F.least("n", F.col("s.need").cast("long")).alias("skipped"))


def bars_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fixed intervals wider than the product's own granularity, with completeness."""
    b = revised(spark, sf_dir).withColumn("at_s", F.floor(F.col("at_us") / 1e6).cast("long"))
    widths = F.explode(F.array(*[F.lit(s) for s in INTERVALS.values()])).alias("width")
    wide = b.select("*", widths).where("width > granularity_s and width % granularity_s = 0")
    keys = ["product_id", "granularity_s", "width"]
    bucket = fixed_bucket("at_s", F.col("width"))
    out = resample(wide, keys, bucket, "at_us", F.floor(F.col("width") / F.col("granularity_s")))
    return out.select("product_id", "width", "bucket", "open", "high", "low", "close", F.round("volume", 4).alias("volume"), "members", F.coalesce("complete", F.lit(False)).alias("complete"))


def _calendar(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    day = F.date_from_unix_date(F.floor(F.col("at_us") / 86_400_000_000.0).cast("int"))
    out = resample(revised(spark, sf_dir), KEYS, calendar_bucket(day, unit), "at_us")
    closed = is_closed(F.col("bucket"), F.lit(KNOWN_AT).cast("date"), unit)
    return out.select("product_id", "bucket", "open", "high", "low", "close", F.round("volume", 4).alias("volume"), "members", closed.alias("closed"))


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar(spark, sf_dir, "day")


def bars_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar(spark, sf_dir, "week")


def bars_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar(spark, sf_dir, "month")


def bars_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars of daily_bars by their New York day, with trade counts and mean prices where all have one; of a day's revisions the last."""
    one = bars_by_day(spark, sf_dir).where("symbol is not null").groupBy("symbol", "day").agg(F.max(F.struct("available_at", "bar_id", "o", "h", "l", "c", "v", "n", "vw")).alias("x"))
    one = one.where("x.h >= x.l and x.l > 0 and x.c >= x.l and x.c <= x.h and x.v >= 0")
    b = one.select("symbol", F.date_from_unix_date("day").alias("at"), F.col("x.o").alias("open"), F.col("x.h").alias("high"), F.col("x.l").alias("low"), F.col("x.c").alias("close"), F.col("x.v").alias("volume"), F.col("x.n").alias("trade_count"), F.col("x.vw").alias("vwap"))
    out = resample(b, ["symbol"], calendar_bucket(F.col("at"), "month"), "at")
    return out.select("symbol", "bucket", "high", "low", "volume", "members", "trade_count", F.round("vwap", 4).alias("vwap"))


def bars_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars to long observations and back, by field: a round trip whose counts must agree."""
    fields = ["open", "high", "low", "close", "volume"]
    long = unpivot_fields(revised(spark, sf_dir), ["product_id", "at_us"], fields)
    wide = pivot_fields(long, ["product_id", "at_us"], "field_name", "value", [*fields, "vwap"])
    return wide.groupBy("product_id").agg(F.count(F.lit(1)).alias("bars"), F.sum(F.size("missing")).alias("missing"), F.sum(F.size("duplicated")).alias("duplicated"), F.max("high").alias("top"))


def bars_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the import runs asked for, as united intervals."""
    runs = table(spark, sf_dir, "import_summaries").select("product_id", F.expr(micros_sql("requested_start")).alias("begins"), F.expr(micros_sql("requested_end")).alias("ends"))
    return merged_intervals(runs, KEYS, "begins", "ends")


def pit_latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of each candle at the cut: revisions, ties and superseded ones."""
    c = table(spark, sf_dir, "spot_candles").where("product_id is not null and candle_start is not null").select("product_id", F.expr(micros_sql("candle_start")).alias("at_us"), "available_at", "candle_id", "close_price", "volume").distinct()
    known = eligible(c, F.lit(KNOWN_AT).cast("timestamp_ntz"))
    out = latest_revision(known, ["product_id", "at_us"], "available_at", ["close_price", "volume"], "candle_id")
    return out.select("product_id", "at_us", "candle_id", "close_price", "ambiguous", "revisions", "superseded")


def pit_history_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a half-open event range that were available at the cut, counted for each product."""
    c = table(spark, sf_dir, "spot_candles")
    ts = lambda x: F.lit(x).cast("timestamp_ntz")
    own = eligible(c, ts(KNOWN_AT), event="candle_start", start=ts("2025-11-01 00:00:00"), end=ts("2025-11-08 00:00:00"))
    return own.groupBy("product_id").agg(F.count_distinct("candle_id").alias("candles"), F.min("candle_start").alias("first_start"), F.max("candle_start").alias("last_start"), F.max("available_at").alias("last_available"))


def pit_effective_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = effective_cut(table(spark, sf_dir, "observations").where("asset_id is not null"), ["asset_id"], F.lit("2016-01-01 00:00:00").cast("timestamp_ntz"))
    return out.where("earliest is not null")


def cmp_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which both of two products have a bar, with their last closes."""
    one, two = COMPARED
    return aligned(_calendar(spark, sf_dir, "day"), "product_id", "bucket", "close", COMPARED).select("bucket", F.round(f"`{one}`", 4).alias("one"), F.round(f"`{two}`", 4).alias("two"))


def cmp_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily closes of every product against BTC-USD over their common days: covariance, correlation, beta, returns."""
    return pair_statistics(_calendar(spark, sf_dir, "day"), "product_id", "bucket", "close", "BTC-USD")


def cmp_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_statistics(bars(spark, sf_dir), KEYS, "at_us")


def asof_candle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each summary with the close of the last candle that was available when it was made, as it was known then."""
    s = table(spark, sf_dir, "perpetual_summaries").where("creation_timestamp is not null and instrument_name is not null and summary_id is not null").select(
        "summary_id", F.concat(F.regexp_replace("instrument_name", "-PERPETUAL$", ""), F.lit("-USD")).alias("product_id"), (F.col("creation_timestamp") * 1000).alias("when")
    ).distinct()
    c = table(spark, sf_dir, "spot_candles").where("product_id is not null and candle_start is not null and available_at is not null and candle_id is not null")
    known = c.select("product_id", F.expr(micros_sql("available_at")).alias("seen_us"), F.expr(micros_sql("candle_start")).alias("at_us"), "candle_id", F.col("close_price").alias("close"))
    out = best_known(s, known, KEYS, "when", "seen_us", DAY, ["at_us", "seen_us", "candle_id"], ["close"])
    return out.where("close is not null").select("summary_id", "at_us", "close")


def der_spread_bps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread in basis points of the mid price; none where the mid isn't above zero or the quotes cross."""
    s = table(spark, sf_dir, "perpetual_summaries").where("mid_price > 0 and ask_price >= bid_price").select("summary_id", "instrument_name", F.round((F.col("ask_price") - F.col("bid_price")) / F.col("mid_price") * 10000, 6).alias("spread_bps"))
    return s.distinct()


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean funding by instrument and hour of the event time.

    A redelivery may state its time more or less finely, so records of one instrument and second are one record: the one
    available last. Different records of an hour are averaged.
    """
    f = table(spark, sf_dir, "funding_history").where("interest_1h is not null and available_at is not null")
    timed = with_instant(f, "funding_timestamp", "feed", table(spark, sf_dir, "feed_zones")).where("utc_ms is not null")
    second = F.floor(F.col("utc_ms") / F.lit(1000.0)).cast("long")
    one = timed.groupBy("instrument_name", second.alias("second")).agg(F.max_by("interest_1h", F.struct("available_at", "funding_id")).alias("rate"))
    return one.groupBy("instrument_name", F.floor(F.col("second") / F.lit(3600.0)).cast("long").alias("hour")).agg(F.avg("rate").alias("rate"))


def _funding_sums(hours: DataFrame, n: int) -> DataFrame:
    return ind.gap_free_sum(hours, ["instrument_name"], n, "rate", "hour").select("instrument_name", F.lit(n).alias("hours"), "hour", F.round("total", 12).alias("total"), F.round("mean", 12).alias("mean"))


def der_funding_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _funding_sums(index_rows(_hours(spark, sf_dir), ["instrument_name"], "hour", 24 * 30), 24).drop("hours")


def der_funding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and mean of the funding of 24, 168 and 720 consecutive hours; a gap among them gives no row."""
    hours = index_rows(_hours(spark, sf_dir), ["instrument_name"], "hour", 24 * 30)
    return _funding_sums(hours, 24).unionAll(_funding_sums(hours, 168)).unionAll(_funding_sums(hours, 720))


def der_change_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the daily mean open interest over 1 and 7 days, where every day between is there."""
    day = F.floor(F.col("creation_timestamp") / F.lit(86_400_000.0)).cast("long")
    s = table(spark, sf_dir, "perpetual_summaries").where("open_interest is not null and creation_timestamp is not null").select("summary_id", "instrument_name", day.alias("day"), "open_interest").distinct()
    days = index_rows(s.groupBy("instrument_name", "day").agg(F.avg("open_interest").alias("oi")), ["instrument_name"], "day", 365)
    one = [ind.lagged_change(days, ["instrument_name"], k, "oi", "day").select("instrument_name", "day", F.lit(k).alias("days"), F.round("change", 2).alias("change")) for k in (1, 7)]
    return one[0].unionAll(one[1])


def der_latest_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last summary of each instrument with a funding value."""
    s = table(spark, sf_dir, "perpetual_summaries").where("current_funding is not null and creation_timestamp is not null")
    return s.groupBy("instrument_name").agg(F.max_by("current_funding", F.struct("creation_timestamp", "summary_id")).alias("current_funding"), F.max("creation_timestamp").alias("as_of"))


QUERIES = {
    f.__name__: f
    for f in (
        ind_return, ind_sma_20, ind_volatility_20, ind_relative_volume_20, ind_bollinger_20_2, ind_true_range, ind_ema_20, ind_rsi_14, ind_atr_14, ind_macd_12_26_9,
        ind_drawdown, ind_normalised, ind_warm_up, bars_fixed, bars_daily, bars_weekly, bars_monthly, bars_weighted, bars_fields, bars_coverage, bars_status, pit_latest_revision,
        pit_history_range, pit_effective_cut, cmp_calendar, cmp_pairs, cmp_range, asof_candle, der_spread_bps, der_funding_24h, der_funding_windows, der_change_days, der_latest_slots,
    )
}

_CAL = """ select product_id, bucket, arg_min(open, at_us) as open, max(high) as high, min(low) as low, arg_max(close, at_us) as close,
  round(sum(volume), 4) as volume, count(*) as members, bucket <> date_trunc('{u}', date '2025-11-15')::date as closed
  from (select *, date_trunc('{u}', make_timestamp(at_us))::date as bucket from bars) x group by product_id, bucket"""


def _seeded(source: str, value: str, out: str, n: int, weight: float, name: str) -> str:
    """CTEs ``name`` with the recursive mean ``out`` of ``value`` over ``source`` (product_id, at_us, rn)."""
    return f""", {name}_seed as (select *, avg({value}) over (partition by product_id order by rn rows between {n - 1} preceding and current row) as seed from {source}),
{name} as (select product_id, at_us, rn, seed as {out} from {name}_seed where rn = {n - 1}
  union all select s.product_id, s.at_us, s.rn, e.{out} + {weight!r} * (s.{value} - e.{out}) from {name} e join {source} s on s.product_id = e.product_id and s.rn = e.rn + 1)"""


_MOVES = """, moves0 as (select product_id, at_us, rn - 1 as rn, close - lag(close) over (partition by product_id order by rn) as d from bars),
moves as (select product_id, at_us, rn, greatest(d, 0) as gain, greatest(-d, 0) as loss from moves0 where rn >= 0)"""
_TR = """, ranges as (select product_id, at_us, rn, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) as tr
  from (select *, lag(close) over (partition by product_id order by rn) as pc from bars) x)"""
_W = "over (partition by product_id order by rn rows between {a} preceding and {b})"

_HOURLY = "with " + instants("i", "select distinct funding_id as id, funding_timestamp as t, feed from funding_history") + """,
    s as (select instrument_name, i.ms // 1000 as second, arg_max(interest_1h, (available_at, funding_id)) as rate from funding_history f join i on i.id = f.funding_id where i.ms is not null and interest_1h is not null and available_at is not null group by 1, 2),
    h as (select instrument_name, second // 3600 as hour, avg(rate) as rate from s group by 1, 2)"""
SQL = {
    "ind_return": _BARS + "select product_id, at_us, round(close / pc - 1, 6) as ret from (select *, lag(close) over (partition by product_id order by rn) as pc from bars) x where pc is not null",
    "ind_sma_20": _BARS + f"select product_id, at_us, round(m, 6) as sma from (select *, avg(close) {_W.format(a=19, b='current row')} as m from bars) x where rn >= 19",
    "ind_volatility_20": _BARS + f""", r as (select product_id, at_us, rn, close / lag(close) over (partition by product_id order by rn) - 1 as ret from bars)
        select product_id, at_us, round(v, 6) as volatility from (select *, stddev_samp(ret) {_W.format(a=19, b='current row')} as v from r) x where rn >= 20""",
    "ind_relative_volume_20": _BARS + f"select product_id, at_us, round(volume / b, 4) as relative_volume from (select *, avg(volume) {_W.format(a=20, b='1 preceding')} as b from bars) x where rn >= 20 and b <> 0",
    "ind_bollinger_20_2": _BARS + f"""select product_id, at_us, round(m + 2 * s, 4) as upper, round(m - 2 * s, 4) as lower, round(4 * s / m, 4) as bandwidth, round((close - (m - 2 * s)) / (4 * s), 4) as percent_b
        from (select *, avg(close) {_W.format(a=19, b='current row')} as m, stddev_pop(close) {_W.format(a=19, b='current row')} as s from bars) x where rn >= 19 and s > 1e-12 * m""",
    "ind_true_range": _BARS + _TR + "select product_id, at_us, round(tr, 4) as true_range from ranges",
    "ind_ema_20": _RBARS + _seeded("bars", "close", "ema", 20, 2 / 21, "e") + "select product_id, at_us, round(ema, 4) as ema from e",
    "ind_rsi_14": _RBARS + _MOVES + _seeded("moves", "gain", "ag", 14, 1 / 14, "g") + _seeded("moves", "loss", "al", 14, 1 / 14, "l") + """
        select g.product_id, g.at_us, round(case when ag + al = 0 then 50 else 100 * ag / (ag + al) end, 4) as rsi from g join l on g.product_id = l.product_id and g.rn = l.rn""",
    "ind_atr_14": _RBARS + _TR + _seeded("ranges", "tr", "atr", 14, 1 / 14, "a") + "select product_id, at_us, round(atr, 4) as atr from a",
    "ind_macd_12_26_9": _RBARS + _seeded("bars", "close", "f", 12, 2 / 13, "ef") + _seeded("bars", "close", "s", 26, 2 / 27, "es") + """,
        lines as (select es.product_id, es.at_us, es.rn - 25 as rn, f - s as line from es join ef on es.product_id = ef.product_id and es.rn = ef.rn)"""
        + _seeded("lines", "line", "signal", 9, 0.2, "sg") + "select l.product_id, l.at_us, round(line, 4) as line, round(signal, 4) as signal, round(line - signal, 4) as histogram from sg join lines l on l.product_id = sg.product_id and l.rn = sg.rn",
    "ind_drawdown": _BARS + "select product_id, at_us, round(peak, 6) as peak, round(close / peak - 1, 6) as drawdown from (select *, max(close) over (partition by product_id order by rn) as peak from bars) x",
    "ind_normalised": _BARS + "select product_id, at_us, round(100 * close / first_value(close) over (partition by product_id order by rn), 4) as normalised from bars",
    "ind_warm_up": _BARS + """select product_id, indicator, least(n, need) as skipped from (select product_id, count(*) as n from bars group by 1) b,
        (values ('sma_20', 19), ('volatility_20', 20), ('relative_volume_20', 20), ('rsi_14', 14), ('atr_14', 13), ('macd_12_26_9', 33)) v(indicator, need)""",
    "bars_fixed": _BARS + """select product_id, width, bucket, arg_min(open, at_us) as open, max(high) as high, min(low) as low, arg_max(close, at_us) as close, round(sum(volume), 4) as volume,
        count(*) as members, count(*) = width // granularity_s as complete
        from (select b.*, w as width, (at_us // 1000000) // w * w as bucket from bars b, (values (60), (300), (900), (1800), (2700), (3600), (7200), (14400), (18000)) v(w) where w > granularity_s and w % granularity_s = 0) x
        group by product_id, granularity_s, width, bucket""",
    "bars_daily": _BARS + _CAL.format(u="day"),
    "bars_weekly": _BARS + _CAL.format(u="week"),
    "bars_monthly": _BARS + _CAL.format(u="month"),
    "bars_weighted": f"""with {BARS_BY_DAY},
        one as (select * from bars_by_day where symbol is not null qualify row_number() over (partition by symbol, day order by available_at desc nulls last, bar_id desc) = 1)
        select symbol, date_trunc('month', day)::date as bucket, max(h) as high, min(l) as low, sum(v) as volume, count(*) as members,
        case when count(n) = count(*) then sum(n) end as trade_count, case when count(vw) = count(*) and sum(v) > 0 then round(sum(vw * v) / sum(v), 4) end as vwap
        from one where h >= l and l > 0 and c >= l and c <= h and v >= 0 group by 1, 2""",
    "bars_fields": _BARS + "select product_id, count(*) as bars, count(*) as missing, 0 as duplicated, max(high) as top from bars group by 1",
    "bars_status": _BARS + """select product_id, count(*) as candles, count(*) filter (valid and not ambiguous) as usable, count(*) filter (not valid and not ambiguous) as invalid, count(*) filter (ambiguous) as ambiguous
        from versions group by 1""",
    "bars_coverage": """with r as (select product_id, epoch_us(requested_start) as b, epoch_us(requested_end) as e from import_summaries where requested_start < requested_end),
        m as (select *, max(e) over (partition by product_id order by b, e rows between unbounded preceding and 1 preceding) as reach from r),
        i as (select *, sum(case when reach >= b then 0 else 1 end) over (partition by product_id order by b, e rows unbounded preceding) as g from m)
        select product_id, min(b) as begins, max(e) as ends from i group by product_id, g""",
    "pit_latest_revision": """with k as (select distinct product_id, epoch_us(candle_start) as at_us, available_at, candle_id, close_price, volume from spot_candles where available_at <= timestamp '2025-11-15 00:00:00'),
        m as (select *, max(available_at) over (partition by product_id, at_us) as last, count(*) over (partition by product_id, at_us) as revisions from k),
        t as (select * from m where available_at = last)
        select product_id, at_us, min(candle_id) as candle_id, arg_min(close_price, candle_id) as close_price,
          count(distinct (coalesce(close_price, -1), coalesce(volume, -1))) > 1 as ambiguous, max(revisions) as revisions, max(revisions) - count(*) as superseded
        from t group by product_id, at_us""",
    "pit_history_range": """select product_id, count(distinct candle_id) as candles, min(candle_start) as first_start, max(candle_start) as last_start, max(available_at) as last_available from spot_candles
        where available_at <= timestamp '2025-11-15 00:00:00' and candle_start >= timestamp '2025-11-01 00:00:00' and candle_start < timestamp '2025-11-08 00:00:00' group by 1""",
    "pit_effective_cut": "select asset_id, min(available_at) as earliest, min(available_at) > timestamp '2016-01-01 00:00:00' as too_early from observations where asset_id is not null group by 1 having min(available_at) is not null",
    "cmp_calendar": _BARS + """, d as (select product_id, make_timestamp(at_us)::date as bucket, arg_max(close, at_us) as close from bars group by 1, 2)
        select a.bucket, round(a.close, 4) as one, round(b.close, 4) as two from d a join d b on a.bucket = b.bucket where a.product_id = 'ZZQKX-USD' and b.product_id = 'ZCCFX-USD'""",
    "cmp_pairs": _BARS + """, d as (select product_id, (at_us // 86400000000) as day, arg_max(close, at_us) as close from bars group by 1, 2),
        j as (select p.product_id, p.day, p.close as pc, b.close as bc from d p join d b on p.day = b.day where b.product_id = 'BTC-USD' and p.product_id <> 'BTC-USD'),
        r as (select product_id, day, pc, bc, pc / lag(pc) over w - 1 as pr, bc / lag(bc) over w - 1 as br from j window w as (partition by product_id order by day))
        select product_id, count(*) as days, round(arg_max(pc, day) / arg_min(pc, day) - 1, 6) as total_return, round(stddev_samp(pr), 6) as volatility, round(covar_samp(pr, br), 8) as covariance,
          case when count(pr) < 2 then 'too_few' when var_samp(pr) < 1e-18 or var_samp(br) < 1e-18 then 'no_variance' else 'ok' end as status,
          case when count(pr) >= 2 and var_samp(pr) >= 1e-18 and var_samp(br) >= 1e-18 then round(covar_samp(pr, br) / (stddev_samp(pr) * stddev_samp(br)), 6) end as correlation,
          case when count(pr) >= 2 and var_samp(br) >= 1e-18 then round(covar_samp(pr, br) / var_samp(br), 6) end as beta
        from r group by product_id""",
    "cmp_range": _BARS + """, p as (select *, max(close) over (partition by product_id order by rn) as peak from bars)
        select product_id, count(*) as n, max(high) as high, min(low) as low, round(arg_max(close, at_us) / arg_min(close, at_us) - 1, 6) as total_return, round(min(close / peak - 1), 6) as max_drawdown from p group by 1""",
    "asof_candle": """with s as (select distinct summary_id, regexp_replace(instrument_name, '-PERPETUAL$', '') || '-USD' as product_id, make_timestamp(creation_timestamp * 1000) as t from perpetual_summaries where creation_timestamp is not null and summary_id is not null),
        j as (select s.summary_id, epoch_us(c.candle_start) as at_us, c.close_price as close, row_number() over (partition by s.summary_id order by c.candle_start desc, c.available_at desc, c.candle_id desc) as k
          from s join (select distinct * from spot_candles) c on c.product_id = s.product_id and c.available_at <= s.t where c.candle_start is not null and c.candle_id is not null)
        select summary_id, at_us, close from j where k = 1 and close is not null""",
    "der_spread_bps": "select distinct summary_id, instrument_name, round((ask_price - bid_price) / mid_price * 10000, 6) as spread_bps from perpetual_summaries where mid_price > 0 and ask_price >= bid_price",
    "der_funding_24h": _HOURLY + """ select instrument_name, hour, round(t, 12) as total, round(t / 24, 12) as mean from (select *, sum(rate) over w as t, lag(hour, 23) over (partition by instrument_name order by hour) as f from h
        window w as (partition by instrument_name order by hour rows between 23 preceding and current row)) y where hour - f = 23""",
    "der_funding_windows": _HOURLY + " union all ".join(f""" select instrument_name, {n} as hours, hour, round(t, 12) as total, round(t / {n}, 12) as mean from (select *, sum(rate) over w as t, lag(hour, {n - 1}) over (partition by instrument_name order by hour) as f from h
        window w as (partition by instrument_name order by hour rows between {n - 1} preceding and current row)) y where hour - f = {n - 1}""" for n in (24, 168, 720)),
    "der_change_days": """with d as (select instrument_name, creation_timestamp // 86400000 as day, avg(open_interest) as oi from (select distinct summary_id, instrument_name, creation_timestamp, open_interest from perpetual_summaries where open_interest is not null and creation_timestamp is not null) x group by 1, 2),
        k as (select * from (values (1), (7)) v(days))
        select a.instrument_name, a.day, k.days, round(a.oi - b.oi, 2) as change from d a, k, d b where a.instrument_name = b.instrument_name and b.day = a.day - k.days
          and (select count(*) from d c where c.instrument_name = a.instrument_name and c.day between b.day and a.day) = k.days + 1""",
    "der_latest_slots": """select instrument_name, arg_max(current_funding, (creation_timestamp, summary_id)) as current_funding, max(creation_timestamp) as as_of from perpetual_summaries
        where current_funding is not null and creation_timestamp is not null group by 1""",
}
