"""p1 and p3: facts known at a request, and gapless series of candles and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.operators.bitemporal import locate, rectangles
from pitspark.operators.normalise_times import with_instant
from pitspark.operators.regular_grid import counter_increments, regular_series
from pitspark.plans.instant_sql import instants
from pitspark.session import micros_sql, table


def p1_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles of valid and recorded time of all annual facts."""
    facts = table(spark, sf_dir, "observations").where("frequency = 'annual' and quality = 'valid'")
    return rectangles(
        facts.select(
            F.col("asset_id").alias("entity"),
            F.col("field_name").alias("attribute"),
            F.col("observation_id").alias("fact_id"),
            F.expr(micros_sql("period_end")).alias("period_end"),
            F.expr(micros_sql("available_at")).alias("known"),
        )
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = (
        table(spark, sf_dir, "valuation_requests")
        .select(
            F.col("request_id").alias("point_id"),
            F.col("asset_id").alias("entity"),
            F.datediff("valuation_date", F.lit("1970-01-01").cast("date")).alias("at_day"),
            F.expr(micros_sql("known_at")).alias("at_micros"),
        )
        .distinct()
    )
    return locate(points, p1_regions(spark, sf_dir)).select(F.col("point_id").alias("request_id"), F.col("fact_id").alias("observation_id"))


def _seconds(column: str) -> Column:
    """Whole seconds since the epoch of a timestamp without zone, rounded down."""
    return F.floor(F.expr(micros_sql(column)) / F.lit(1_000_000.0)).cast("long")


def _candle_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that begin in [requested_start, requested_end) of the runs."""
    step, micros = F.col("granularity_s"), lambda c: F.expr(micros_sql(c))
    first = lambda c: F.ceil(micros(c) / (step * 1_000_000.0)).cast("long")
    runs = table(spark, sf_dir, "import_summaries").where("granularity_s > 0")
    return runs.select(F.col("product_id").alias("series"), step.cast("long").alias("step"), first("requested_start").alias("first"), (first("requested_end") - 1).alias("last"))


def _candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "spot_candles").where("granularity_s > 0 and close_price is not null")


def _candle_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.col("granularity_s").cast("long")
    return _candles(spark, sf_dir).select(F.col("product_id").alias("series"), step.alias("step"), F.floor(_seconds("candle_start") / step).alias("cell"))


def bars_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """daily_bars with the New York day of t, in days since the epoch; bars whose t states no instant are left out."""
    timed = with_instant(table(spark, sf_dir, "daily_bars"), "t", "feed", table(spark, sf_dir, "feed_zones"))
    utc = "timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(utc_ms / 1000 as decimal(18, 6)))"
    return timed.where("utc_ms is not null").withColumn("day", F.expr(f"datediff(cast(convert_timezone('UTC', 'America/New_York', {utc}) as date), date'1970-01-01')"))


def _candle_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candle period, whether a candle begins in it, and its share of the volume; a candle that begins off the grid
    shares it with the next. A redelivered candle counts once: of candles that begin together, the largest volume."""
    candles = _candles(spark, sf_dir).where("volume is not null").select(
        F.col("product_id").alias("series"), F.col("granularity_s").cast("long").alias("step"), _seconds("candle_start").alias("at"), "volume"
    )
    once = candles.groupBy("series", "step", "at").agg(F.max("volume").alias("amount")).withColumn("until", F.col("at") + F.col("step"))
    return regular_series(_candle_windows(spark, sf_dir), _candle_cells(spark, sf_dir), once)


def _bar_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day from a symbol's first bar to its last, whether it has a bar, and its volume (of a day's bars the largest)."""
    days = bars_by_day(spark, sf_dir).where("symbol is not null").groupBy(F.col("symbol").alias("series"), F.col("day").cast("long").alias("cell")).agg(F.max("v").cast("double").alias("amount"))
    readings = days.withColumn("step", F.lit(1).cast("long"))
    return regular_series(None, readings, readings.select("series", "step", F.col("cell").alias("at"), (F.col("cell") + 1).alias("until"), "amount"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periods of the regular series that no reading covers; of bars those on working days."""
    at = F.col("cell") * F.col("step")
    # the text of a time is made from its day and its clock, so that the session's zone plays no part
    clock = F.date_format(F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(pmod(cell * step, 86400) as decimal(18, 6)))"), "'T'HH:mm:ss'Z'")
    begins = F.concat(F.date_format(F.date_from_unix_date(F.floor(at / 86_400.0).cast("int")), "yyyy-MM-dd"), clock)
    candles = _candle_series(spark, sf_dir).where("not covered").select("series", begins.alias("period"))
    days = _bar_series(spark, sf_dir).where("not covered").withColumn("date", F.date_from_unix_date(F.col("cell").cast("int"))).where("weekday(date) < 5")
    return candles.unionAll(days.select("series", F.date_format("date", "yyyy-MM-dd").alias("period")))


def p3_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candle period with its share of the volume."""
    return _candle_series(spark, sf_dir).select(
        F.col("series").alias("product_id"), F.date_from_unix_date(F.floor(F.col("cell") * F.col("step") / 86_400.0).cast("int")).alias("day"), (F.col("cell") * F.col("step")).alias("begins_s"), "covered", F.round("amount", 6).alias("volume")
    )


def p3_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instruments' running volume, read at odd times and reset now and then, as hourly increments."""
    readings = table(spark, sf_dir, "perpetual_summaries").select(F.col("instrument_name").alias("series"), F.col("creation_timestamp").alias("at"), F.col("volume").alias("value"))
    hour = F.lit(3_600_000).cast("long")
    steps = counter_increments(readings, block=30 * 86_400_000).withColumn("step", hour)
    own = readings.where("series is not null and at is not null and value is not null")
    cells = own.select("series", hour.alias("step"), F.floor(F.col("at") / hour).alias("cell"))
    return regular_series(None, cells, steps).select(F.col("series").alias("instrument_name"), (F.col("cell") * 3600).alias("begins_s"), "covered", F.round("amount", 4).alias("volume"))


QUERIES = {"p1_found": p1_found, "p1_regions": p1_regions, "p3_found": p3_found, "p3_series": p3_series, "p3_counters": p3_counters}
#: CTEs that end in bars_by_day: the rows of daily_bars with their New York date.
BARS_BY_DAY = instants("bar_times", "select distinct bar_id as id, t, feed from daily_bars") + """,
    bars_by_day as (select d.*, timezone('America/New_York', make_timestamptz(i.ms * 1000))::date as day from (select distinct * from daily_bars) d join bar_times i on d.bar_id = i.id where i.ms is not null)"""
SQL = {
    "p3_found": f"""with {BARS_BY_DAY},
        w as (select distinct product_id, g, unnest(range((epoch_us(requested_start) + g * 1000000 - 1) // (g * 1000000), (epoch_us(requested_end) + g * 1000000 - 1) // (g * 1000000))) as cell
          from (select *, granularity_s::bigint as g from import_summaries where granularity_s > 0) i),
        v as (select distinct product_id, granularity_s::bigint as g, epoch_us(candle_start) // (granularity_s::bigint * 1000000) as cell from spot_candles where granularity_s > 0 and close_price is not null),
        b as (select distinct symbol, day from bars_by_day where symbol is not null), r as (select symbol, unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from b group by 1)
        select product_id as series, strftime(make_timestamp(cell * g * 1000000), '%Y-%m-%dT%H:%M:%SZ') as period from w where product_id is not null and not exists (select 1 from v where v.product_id = w.product_id and v.g = w.g and v.cell = w.cell)
        union all select symbol, strftime(day, '%Y-%m-%d') from r where isodow(day) < 6 and not exists (select 1 from b where b.symbol = r.symbol and b.day = r.day)""",
    "p1_found": """
        select request_id, observation_id from (
          select r.request_id, o.observation_id, row_number() over (partition by r.request_id, o.field_name
            order by o.period_end desc, o.available_at desc, o.observation_id) as k
          from (select distinct * from valuation_requests) r join (select distinct * from observations) o
            on o.asset_id = r.asset_id and o.available_at <= r.known_at and cast(o.period_end as date) <= r.valuation_date
          where o.frequency = 'annual' and o.quality = 'valid' and o.observation_id is not null and o.field_name is not null) x
        where k = 1""",
    "p3_series": """with w as (select distinct product_id, g, unnest(range((epoch_us(requested_start) + g * 1000000 - 1) // (g * 1000000), (epoch_us(requested_end) + g * 1000000 - 1) // (g * 1000000))) as cell
          from (select *, granularity_s::bigint as g from import_summaries where granularity_s > 0) i),
        k as (select product_id, granularity_s::bigint as g, epoch_us(candle_start) // 1000000 as s, volume from spot_candles where granularity_s > 0 and close_price is not null),
        c as (select product_id, g, s, max(volume) as amount from k where volume is not null group by 1, 2, 3),
        d as (select product_id, g, s // g as cell, amount * (g - s % g) / g as a from c union all select product_id, g, s // g + 1, amount * (s % g) / g from c where s % g > 0),
        t as (select product_id, g, cell, sum(a) as volume from d group by 1, 2, 3), v as (select distinct product_id, g, s // g as cell from k)
        select w.product_id, (date '1970-01-01' + (w.cell * w.g // 86400)::int)::date as day, w.cell * w.g as begins_s, v.cell is not null as covered, round(t.volume, 6) as volume
        from w left join t on w.product_id = t.product_id and w.g = t.g and w.cell = t.cell left join v on w.product_id = v.product_id and w.g = v.g and w.cell = v.cell""",
    "p3_counters": """with r as (select instrument_name as s, creation_timestamp as b, max(volume) as v from perpetual_summaries where instrument_name is not null and creation_timestamp is not null and volume is not null group by 1, 2),
        i as (select s, lag(b) over w as a, b, case when v < lag(v) over w then v else v - lag(v) over w end as amount from r window w as (partition by s order by b)),
        c as (select *, unnest(range(a // 3600000, (b - 1) // 3600000 + 1)) as cell from i where a is not null),
        t as (select s, cell, sum(amount * (least(b, (cell + 1) * 3600000) - greatest(a, cell * 3600000)) / (b - a)) as volume from c group by 1, 2),
        g as (select s, unnest(range(min(b // 3600000), max(b // 3600000) + 1)) as cell from r group by 1), v as (select distinct s, b // 3600000 as cell from r)
        select g.s as instrument_name, g.cell * 3600 as begins_s, v.cell is not null as covered, round(t.volume, 4) as volume
        from g left join t on g.s = t.s and g.cell = t.cell left join v on g.s = v.s and g.cell = v.cell""",
}
