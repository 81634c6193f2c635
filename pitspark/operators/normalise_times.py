"""Times in mixed formats, precisions and zones as one instant in UTC."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions.instants import parse_instants


def _kernel(period: bool):
    @F.pandas_udf("long")
    def utc_ms(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, zone, day_first in parts:
            ms, ok = parse_instants(text.tolist(), zone.tolist(), day_first.tolist(), period)
            yield pd.Series(ms, dtype="Int64").mask(~ok)

    return utc_ms


def instant_ms(text: Column, zone: Column, day_first: Column, period: bool = False) -> Column:
    """Epoch milliseconds of a text, null where it states no instant (see ``parse_instants``)."""
    return _kernel(period)(text, zone, day_first)


def with_instant(df: DataFrame, text: str, feed: str, feed_zones: DataFrame, out: str = "utc_ms", period: bool = False) -> DataFrame:
    """df with one more column: the instant in epoch milliseconds that column ``text`` states.

    feed_zones (feed, zone, day_first) says what a feed means where its texts name no zone; it is a reference table of
    a few rows, which Spark broadcasts when its size is below the session's threshold and shuffles otherwise. Rows are
    never dropped; a null or unknown feed leaves only texts that name their zone readable, and a feed listed twice
    counts once. Extra columns of df stay as they are.
    """
    zones = feed_zones.groupBy(F.col("feed").alias("__feed")).agg(F.min(F.struct("zone", "day_first")).alias("__zone"))
    joined = df.join(zones, df[feed] == zones["__feed"], "left")
    value = instant_ms(joined[text], F.col("__zone.zone"), F.col("__zone.day_first"), period)
    return joined.withColumn(out, value).drop("__feed", "__zone")
