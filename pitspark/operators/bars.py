"""Price bars: pivot from long observations, validity, and resampling to fixed or calendar intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Widths of the fixed intervals, in seconds.
INTERVALS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "45m": 2700, "1h": 3600, "2h": 7200, "4h": 14400, "5h": 18000}


def pivot_fields(observations: DataFrame, keys: list[str], field: str, value: str, fields: list[str]) -> DataFrame:
    """Long rows as wide ones, one for each key: the fields as columns, ``missing`` and ``duplicated`` field names."""
    cells = [F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields]
    counts = [F.count(F.when(F.col(field) == f, F.lit(1))).alias(f"__n_{f}") for f in fields]
    wide = observations.where(F.col(field).isin(fields)).groupBy(*keys).agg(*cells, *counts)
    named = lambda test: F.array_compact(F.array(*[F.when(test(F.col(f"__n_{f}")), F.lit(f)) for f in fields]))
    return wide.select(*keys, *fields, named(lambda n: n == 0).alias("missing"), named(lambda n: n > 1).alias("duplicated"))


def unpivot_fields(bars: DataFrame, keys: list[str], fields: list[str], field: str = "field_name", value: str = "value") -> DataFrame:
    """Wide rows as long ones; null values give no row."""
    return bars.select(*keys, *fields).unpivot(keys, fields, field, value).where(F.col(value).isNotNull())


def is_valid_bar(o: str = "open", h: str = "high", low: str = "low", c: str = "close", v: str = "volume") -> Column:
    """Prices above zero, open and close within low..high, volume not negative; false where a part is null."""
    x = F.col
    return F.coalesce((x(low) > 0) & (x(o) >= x(low)) & (x(o) <= x(h)) & (x(c) >= x(low)) & (x(c) <= x(h)) & (x(v) >= 0), F.lit(False))


def resample(bars: DataFrame, keys: list[str], bucket: Column, at: str, expected: Column | None = None) -> DataFrame:
    """Bars (at, open, high, low, close, volume, and if there trade_count, vwap, quality_rank, available) in buckets.

    First open and last close by time, extremes, summed volume. trade_count only where all members have one; vwap,
    weighted by volume, only where all members have one and the volume is above zero; worst quality, latest
    availability. expected: how many members make the bucket complete.
    """
    x, n = F.col, F.count(F.lit(1))
    aggs = [
        F.min(F.struct(at, "open")).alias("__first"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max(F.struct(at, "close")).alias("__last"),
        F.sum("volume").alias("volume"),
        n.alias("members"),
        F.count_distinct(at).alias("__moments") if expected is not None else F.lit(None).alias("__moments"),
    ]
    if "trade_count" in bars.columns:
        aggs.append(F.when(F.count("trade_count") == n, F.sum("trade_count")).alias("trade_count"))
    if "vwap" in bars.columns:
        aggs.append(F.when((F.count("vwap") == n) & (F.sum("volume") > 0), F.try_divide(F.sum(x("vwap") * x("volume")), F.sum("volume"))).alias("vwap"))
    if "quality_rank" in bars.columns:
        aggs.append(F.max("quality_rank").alias("quality_rank"))
    if "available" in bars.columns:
        aggs.append(F.max("available").alias("available"))
    out = bars.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(*aggs).withColumns({"open": F.col("__first.open"), "close": F.col("__last.close")})
    if expected is not None:
        out = out.withColumn("complete", F.col("__moments") == expected)
    return out.drop("__first", "__last", "__moments")


def fixed_bucket(at: str, seconds: int | Column) -> Column:
    """Start of the interval of that width, counted from the epoch, in which a time (epoch seconds) lies."""
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    return (F.floor(F.col(at) / s.cast("double")) * s).cast("long")


def calendar_bucket(day: Column, unit: str) -> Column:
    """First day of a date's ISO week, month or quarter; the day itself for 'day'."""
    return day if unit == "day" else F.trunc(day, unit)


def is_closed(bucket: Column, known_day: Column, unit: str) -> Column:
    """Whether a calendar interval had ended at the cut."""
    return bucket != calendar_bucket(known_day, unit)


def merged_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Half-open intervals united where they overlap or touch. Intervals that end before they begin are left out.

    Equal intervals are reduced before they move; a key's remaining intervals are ordered in one window.
    """
    from pyspark.sql import Window

    one = df.where(F.col(start) < F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))
    line = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = one.withColumn("__new", F.when(reach >= F.col(start), 0).otherwise(1)).withColumn("__island", F.sum("__new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")
