"""p4: implausible daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.operators.implausible import CHARTS, implausible
from pitspark.operators.normalise_times import with_instant
from pitspark.session import micros_sql, table

#: Readings that repeat together when a source is stuck.
GROUPS = {"price": ["h", "l", "c"], "volume": ["v"]}


def _new_york_day(micros: str) -> str:
    utc = f"timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(({micros}) / 1000000 as decimal(18, 6)))"
    return f"datediff(cast(convert_timezone('UTC', 'America/New_York', {utc}) as date), date'1970-01-01')"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with what speaks against them; of a day's bars the one with the smallest id is charted."""
    bars = table(spark, sf_dir, "daily_bars").where("bar_id is not null").select("bar_id", "symbol", "feed", "t", "h", "l", "c", F.col("v").cast("double").alias("v"), "available_at")
    timed = with_instant(bars, "t", "feed", table(spark, sf_dir, "feed_zones"))
    day = F.coalesce(F.expr(_new_york_day("utc_ms * 1000")), F.expr(_new_york_day(micros_sql("available_at"))))
    rows = timed.select(F.col("bar_id").alias("seen"), F.col("symbol").alias("source"), day.alias("day"), F.col("utc_ms").isNotNull().alias("dated"), "h", "l", "c", "v")
    limits = (F.least("h", "l", "c") <= 0) | (F.col("v") < 0) | (F.col("l") > F.col("h")) | (F.col("c") < F.col("l")) | (F.col("c") > F.col("h"))
    return implausible(rows, limits, CHARTS, GROUPS).withColumnRenamed("seen", "bar_id")


def p4_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar, once, with what speaks against it. A bar whose t is unusable stands on the day it became available."""
    return _flagged(spark, sf_dir).groupBy("bar_id").agg(F.max("impossible").alias("impossible"), F.max("spike").alias("spike"), F.max("stuck").alias("stuck"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagged(spark, sf_dir).where("impossible or spike or stuck").select("bar_id").distinct()


QUERIES = {"p4_found": p4_found, "p4_flags": p4_flags}
SQL: dict[str, str] = {}
