"""p7: the times of four tables as instants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.operators.normalise_times import with_instant
from pitspark.plans.instant_sql import instants
from pitspark.session import table

#: table, id column, column with the text, whether it states a period
TIMED = [
    ("funding_history", "funding_id", "funding_timestamp", False),
    ("daily_bars", "bar_id", "t", False),
    ("sec_filings", "filing_id", "acceptance_date_time", False),
    ("macro_vintages", "vintage_row_id", "observation_date", True),
]


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of the four tables whose text states an instant; a row delivered twice counts once."""
    zones = table(spark, sf_dir, "feed_zones")

    def part(period: bool) -> DataFrame:
        rows = [
            table(spark, sf_dir, name).select(F.lit(name).alias("tbl"), F.col(key).alias("row_id"), F.col(text).alias("text"), "feed")
            for name, key, text, p in TIMED
            if p == period
        ]
        return with_instant(reduce(DataFrame.unionAll, rows), "text", "feed", zones, period=period)

    return (
        part(False).unionAll(part(True)).where("utc_ms is not null and row_id is not null").groupBy("tbl", "row_id").agg(F.min("utc_ms").alias("utc_ms"))
    )


QUERIES = {"p7_found": p7_found}
SQL = {
    "p7_found": "with " + ", ".join(instants(f"i{n}", f"select distinct {key} as id, {text} as t, feed from {name}", p) for n, (name, key, text, p) in enumerate(TIMED))
    + " union all ".join(f" select distinct '{name}' as tbl, id as row_id, ms as utc_ms from i{n} where ms is not null and id is not null" for n, (name, *_) in enumerate(TIMED)),
}
