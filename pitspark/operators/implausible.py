"""Implausible measurements: robust exponentially weighted control charts, run lengths and physical limits.

Each source has a chart for each of its readings, run once forwards and once backwards in time. A chart follows a mean
and a scale that forget exponentially; a value outside the clip is pulled back to it before it updates them, so a
spike moves neither. A value is a spike if it lies beyond the limits of both charts on the same side: a lasting change
of level is far from what came before, but not from what follows. The charts give limits for each day, against which
all rows of that day are then held.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Chart:
    """How one reading is charted: weight of a new value in the mean and in the scale, clip and limit in scales."""

    mean_weight: float
    scale_weight: float = 0.05
    clip: float = 3.0
    limit: float = 6.3
    offset: float = 0.0  # added before taking the logarithm


#: Prices follow a random walk, so the mean is nearly the last value; volumes vary around a slow mean.
CHARTS = {"h": Chart(0.7), "l": Chart(0.7), "c": Chart(0.7), "v": Chart(0.15, limit=5.8, offset=1.0)}
#: So many consecutive equal values are a stuck run.
STUCK = 5
#: The scale at the start is taken from so many first values.
WARM_UP = 40
LEAST_SCALE = 1e-4
#: Sources are charted together until they have so many rows.
ROWS_AT_ONCE = 100_000


def log_reading(value: Column, chart: Chart) -> Column:
    """The charted form of a reading; null where it has none."""
    return F.when(value + chart.offset > 0, F.log(value + F.lit(chart.offset)))


def _limits(x: np.ndarray, charts: list[Chart]) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper limit of each value (sources x time x readings) from the values before it."""
    p = {k: np.array([getattr(c, k) for c in charts]) for k in ("mean_weight", "scale_weight", "clip", "limit")}
    step = np.abs(np.diff(x[:, : WARM_UP + 1], axis=1))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # a source with fewer than two values has no steps
        scale = np.nanmedian(np.where(step > 0, step, np.nan), axis=1) * 1.4826 if step.shape[1] else np.full((len(x), x.shape[2]), np.nan)
    scale = np.where(np.isnan(scale), 0.02, np.maximum(scale, LEAST_SCALE))
    mean = np.full((len(x), x.shape[2]), np.nan)
    low, high = np.full(x.shape, np.nan), np.full(x.shape, np.nan)
    for t in range(x.shape[1]):
        now = x[:, t]
        low[:, t], high[:, t] = mean - p["limit"] * scale, mean + p["limit"] * scale
        there, begins = ~np.isnan(now), np.isnan(mean)
        pulled = np.clip(now - mean, -p["clip"] * scale, p["clip"] * scale)
        follow = there & ~begins
        mean = np.where(there & begins, now, np.where(follow, mean + p["mean_weight"] * pulled, mean))
        grown = scale * (1 - p["scale_weight"]) + p["scale_weight"] * np.abs(pulled) * 1.2533  # mean deviation to standard deviation
        scale = np.where(follow & (pulled != 0), np.maximum(grown, LEAST_SCALE), scale)
    return low, high


def _stuck(same_as_before: np.ndarray) -> np.ndarray:
    """Which positions are part of a run of STUCK equal values or more."""
    run = np.cumsum(~same_as_before) - (0 if len(same_as_before) and not same_as_before[0] else -1)
    lengths = np.bincount(run, minlength=1)
    return lengths[run] >= STUCK


def _by_length(lengths: np.ndarray) -> list[np.ndarray]:
    """Indices of sources of about the same length: the longest of a class is less than twice the shortest."""
    sizes = np.frexp(lengths.astype(float))[1]
    return [np.flatnonzero(sizes == k) for k in np.unique(sizes)]


def _both_ways(values: np.ndarray, begin: np.ndarray, lengths: np.ndarray, charts: list[Chart]) -> tuple[np.ndarray, np.ndarray]:
    """Limits of each row (rows x readings, sources one after another) by the charts forwards and backwards."""
    lower, upper = np.full(values.shape, np.nan), np.full(values.shape, np.nan)
    for own in _by_length(lengths):
        n = lengths[own]
        step = np.arange(n.max())
        inside = step < n[:, None]
        there = begin[own][:, None] + np.where(inside, step, 0)
        back = begin[own][:, None] + np.where(inside, n[:, None] - 1 - step, 0)
        for at, first in ((there, True), (back, False)):
            x = values[at]
            x[~inside] = np.nan
            low, high = _limits(x, charts)
            rows = at[inside]
            if first:
                lower[rows], upper[rows] = low[inside], high[inside]
            else:
                lower[rows], upper[rows] = np.minimum(lower[rows], low[inside]), np.maximum(upper[rows], high[inside])
    return lower, upper


def chart_days(days: DataFrame, charts: dict[str, Chart], groups: dict[str, list[str]]) -> DataFrame:
    """Limits and stuck runs of days (source, day, usable boolean, certain boolean, and the readings), one row for each source and day.

    Gives source, day, certain and the readings as they are (as day_x), for each reading x low_x and high_x (of its
    logarithm; null where nothing lies before and after it), and for each group of readings whether the day is part of a
    run in which they all stay equal. Rows that are not usable don't update a chart. A source has a row for each day at
    most, so that it fits in a task's memory; sources are charted together in classes of about the same length.
    """
    names, list_of = list(charts), list(charts.values())
    schema = "source string, day int, certain boolean, " + ", ".join(f"day_{n} double, low_{n} double, high_{n} double" for n in names) + ", " + ", ".join(f"stuck_{g} boolean" for g in groups)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        source = rows["source"].to_numpy()
        first = np.concatenate([[True], source[1:] != source[:-1]])
        begin = np.flatnonzero(first)
        lengths = np.diff(np.append(begin, len(rows)))
        values = rows[names].to_numpy(dtype=float)
        with np.errstate(invalid="ignore", divide="ignore"):
            logs = np.log(values + np.array([c.offset for c in list_of]))
        logs[~np.isfinite(logs) | ~rows["usable"].to_numpy(dtype=bool)[:, None]] = np.nan
        lower, upper = _both_ways(logs, begin, lengths, list_of)
        out = {"source": source, "day": rows["day"].to_numpy(), "certain": rows["certain"].to_numpy(dtype=bool)}
        for k, n in enumerate(names):
            out[f"day_{n}"], out[f"low_{n}"], out[f"high_{n}"] = values[:, k], lower[:, k], upper[:, k]
        for g, members in groups.items():
            v = rows[members].to_numpy(dtype=float)
            same = np.concatenate([[False], (v[1:] == v[:-1]).all(axis=1)]) & ~first
            out[f"stuck_{g}"] = _stuck(same)
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            waiting.append(batch)
            if sum(map(len, waiting)) >= ROWS_AT_ONCE:
                rows = pd.concat(waiting, ignore_index=True)
                whole = int(np.searchsorted((rows["source"] == rows["source"].iloc[-1]).to_numpy(), True))
                if whole:
                    yield work(rows.iloc[:whole].reset_index(drop=True))
                waiting = [rows.iloc[whole:]]
        if waiting:
            yield work(pd.concat(waiting, ignore_index=True))

    ordered = days.select("source", "day", "usable", "certain", *[F.col(n).cast("double").alias(n) for n in names])
    return ordered.repartition("source").sortWithinPartitions("source", "day").mapInPandas(run, schema)


def implausible(rows: DataFrame, impossible: Column, charts: dict[str, Chart], groups: dict[str, list[str]]) -> DataFrame:
    """rows (source, day, dated boolean, seen, the readings, anything else) with the columns impossible, spike and stuck.

    impossible: the physical limits. day: in days; several rows of a source and day (redeliveries, corrections) are
    charted as one, the possible one seen first, and each of them is held against that day's limits. dated: whether
    the day is certain; a row whose day is not takes part only where no certain one stands. Rows without source or day
    are held against the physical limits alone; null readings are no spikes and end no run but their own group's.

    Rows move once, to their source and day; the reduction to one a day and the comparison with its limits both read that
    exchange. Only one row a source and day moves on to the charts.
    """
    names = list(charts)
    flagged = rows.withColumn("impossible", F.coalesce(impossible, F.lit(False))).repartition("source", "day")
    one = (
        flagged.groupBy("source", "day")
        # whether the keys are there is asked of the groups, so that both readers of the exchange read the same rows
        .agg(F.min(F.struct((~F.col("dated")).alias("guessed"), "impossible", "seen", *names)).alias("r"), F.max(F.col("source").isNotNull() & F.col("day").isNotNull()).alias("placed"))
        .where("placed")
        .select("source", "day", (~F.col("r.impossible")).alias("usable"), (~F.col("r.guessed")).alias("certain"), *[F.col(f"r.{n}").alias(n) for n in names])
    )
    limits = chart_days(one, charts, groups).withColumnsRenamed({"source": "s", "day": "d"}).hint("merge")  # grows with the rows, so it is never broadcast
    joined = flagged.join(limits, (flagged["source"] == F.col("s")) & (flagged["day"] == F.col("d")), "left")
    inside = F.coalesce(F.col("dated") == F.col("certain"), F.lit(False))
    spike, stuck = F.lit(False), F.lit(False)
    for n, chart in charts.items():
        x = log_reading(F.col(n), chart)
        spike = spike | F.coalesce((x < F.col(f"low_{n}")) | (x > F.col(f"high_{n}")), F.lit(False))
    for g, members in groups.items():
        same = F.lit(True)
        for n in members:
            same = same & (F.col(n) == F.col(f"day_{n}"))
        stuck = stuck | F.coalesce(F.col(f"stuck_{g}") & same, F.lit(False))
    return joined.withColumns({"spike": inside & ~F.col("impossible") & spike, "stuck": inside & stuck}).drop(*limits.columns)
