"""The fold of conditions as a stream: state for each stream, events as they happen, each attempt taken once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.operators.conditions import new_state, step

_STATE = "count int, open boolean, until long, last long"


def lifecycle(evaluations: DataFrame, confirmations: int, cooldown: int) -> DataFrame:
    """(stream, at, event) of a streaming DataFrame of evaluations (stream, at, entry, hold), as ``conditions.fold``.

    What was decided stays decided: an evaluation that arrives after a later one of its stream moves nothing, but it is not
    lost either, it comes out as the event 'late'. Where there is none, the events are those of ``fold``; else the streams
    with one are to be folded again. State is four values a stream.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = new_state()
        if state.exists:
            count, opened, until, last = state.get
            own = {"count": count, "open": opened, "until": until, "last": last}
        rows = pd.concat(list(batches)).drop_duplicates().sort_values(["at", "entry", "hold"], ascending=[True, False, False], kind="stable")
        out, before = [], own["last"]
        for at, entry, hold in zip(rows["at"].tolist(), rows["entry"], rows["hold"], strict=True):
            event = "late" if before is not None and at <= before else step(own, at, entry, hold, confirmations, cooldown)
            if event:
                out.append((key[0], at, event))
        state.update((own["count"], own["open"], own["until"], own["last"]))
        yield pd.DataFrame(out, columns=["stream", "at", "event"])

    clean = evaluations.where("stream is not null and at is not null").select("stream", "at", "entry", "hold")
    return clean.groupBy("stream").applyInPandasWithState(run, "stream string, at long, event string", _STATE, "append", "NoTimeout")


def windowed_bars(ticks: DataFrame, at: str, keys: list[str], width: str, late: str | None = None) -> DataFrame:
    """Open, extremes, close and volume of windows of a stream (at timestamp, price, volume).

    Without ``late`` no tick is ever dropped: a late one corrects its window, for output mode update or complete. With it
    a watermark closes windows and bounds their state, and ticks later than that are left out.
    """
    w = F.window(at, width)
    agg = (ticks.withWatermark(at, late) if late else ticks).groupBy(*keys, w).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks")
    )
    return agg.select(*keys, F.col("window.start").alias("begins"), "open", "high", "low", "close", "volume", "ticks")


def once(source: DataFrame, key: str, path: str, checkpoint: str, late: str | None = None, at: str | None = None):
    """A running append of rows whose key hasn't been written; state is bounded if a lateness is given."""
    rows = source.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if late and at else source.dropDuplicates([key])
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
