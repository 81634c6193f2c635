"""p5 and p6: nested records as tables, and the history of macro observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.operators.history import numeric_value, version_history
from pitspark.operators.normalise_times import with_instant
from pitspark.operators.shred import shred, table_of
from pitspark.plans.instant_sql import instants
from pitspark.plans.payload_sql import NODES
from pitspark.session import micros_sql, numbered, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shred(numbered(spark, sf_dir, "raw_records", "record_id", "payload")).select("record_id", "level1", "level2", "level3", "item_no", "sub_no")


def p5_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of company facts, typed."""
    return table_of(shred(numbered(spark, sf_dir, "raw_records", "record_id", "payload")), "fact")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of fact segments; parent_key is the fact's node_key."""
    return table_of(shred(numbered(spark, sf_dir, "raw_records", "record_id", "payload")), "segment")


def macro_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "macro_vintages").where("realtime_start is not null").select(
        "series_id", "feed", "observation_date", "realtime_start", "realtime_end", "raw_value", F.expr(micros_sql("retrieved_at")).alias("seen")
    )
    timed = with_instant(raw, "observation_date", "feed", table(spark, sf_dir, "feed_zones"), "ms", period=True)
    days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    return version_history(
        timed.where("ms is not null").select(
            F.col("series_id").alias("entity"),
            (F.col("ms") / 86_400_000).cast("int").alias("item"),
            days("realtime_start").alias("start"),
            numeric_value(F.col("raw_value")).alias("value"),
            "seen",
            days("realtime_end").alias("until"),
        )
    )


def _text(day: str) -> F.Column:
    return F.date_format(F.date_from_unix_date(day), "yyyy-MM-dd")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_versions(spark, sf_dir).select(
        F.col("entity").alias("series_id"), _text("item").alias("observation_date"), _text("valid_from").alias("valid_from"), _text("valid_to").alias("valid_to")
    )


def p6_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history with the value of each version."""
    return macro_versions(spark, sf_dir).select(
        F.col("entity").alias("series_id"), _text("item").alias("observation_date"), F.col("value").alias("obs_value"), _text("valid_from").alias("valid_from"), _text("valid_to").alias("valid_to")
    )


QUERIES = {"p5_found": p5_found, "p5_facts": p5_facts, "p5_segments": p5_segments, "p6_found": p6_found, "p6_history": p6_history}
_VERSIONS = "with " + instants("i", "select distinct vintage_row_id as id, observation_date as t, feed from macro_vintages", True) + r""",
    m as (select series_id, make_timestamp(i.ms * 1000)::date as od, realtime_start as start, coalesce(realtime_end, date '9999-12-31') as until, coalesce(retrieved_at, timestamp '0001-01-01') as seen,
        case when regexp_full_match(x, '[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?') then try_cast(x as double) end as num
      from (select *, replace(trim(regexp_replace(raw_value, '\s', ' ', 'g')), ',', '') as x from (select distinct * from macro_vintages) d) y join i on i.id = y.vintage_row_id
      where i.ms is not null and realtime_start is not null and series_id is not null),
    k as (select * from m qualify row_number() over (partition by series_id, od, start order by seen desc, num desc nulls last, until desc) = 1),
    c as (select *, case when row_number() over w > 1 and lag(num) over w is not distinct from num then 0 else 1 end as new from k window w as (partition by series_id, od order by start)),
    g as (select *, sum(new) over (partition by series_id, od order by start rows unbounded preceding) as version from c),
    v as (select series_id, od, version, min(start) as valid_from, arg_max(until, (seen, start)) as until, any_value(num) as num from g group by 1, 2, 3),
    h as (select *, least(until, coalesce(lead(valid_from) over (partition by series_id, od order by version) - 1, date '9999-12-31')) as valid_to from v)
    select series_id, strftime(od, '%Y-%m-%d') as observation_date, """
_PLACES = "strftime(valid_from, '%Y-%m-%d') as valid_from, strftime(valid_to, '%Y-%m-%d') as valid_to from h"
SQL = {"p5_found": NODES + " select * from nodes", "p6_found": _VERSIONS + _PLACES, "p6_history": _VERSIONS + "num as obs_value, " + _PLACES}
