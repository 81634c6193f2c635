"""History of changing attributes from snapshots: every version with the period in which it was valid.

Snapshot rows are reduced to one for each key, start and value before they move, then brought together by key and
sorted by time. A merging iterator reads each partition once and emits a version as soon as the next one begins; it
holds one open version, never a history.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Day 9999-12-31, an open end, in days since the epoch.
OPEN_END = 2_932_896

VERSION_SCHEMA = "entity string, item int, value double, valid_from int, valid_to int"


def numeric_value(raw: Column) -> Column:
    """A number written with blanks, a sign, thousands commas or an exponent; null for anything else ('.', 'NA', '')."""
    text = F.regexp_replace(F.trim(F.regexp_replace(raw, r"\s", " ")), ",", "")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by entity, item, start, seen: closed versions.

    Kept from one batch to the next: the open version and the last row, which a later row of the same start may
    replace.
    """
    kept: pd.DataFrame | None = None

    def versions(rows: pd.DataFrame, last: pd.Series | None) -> tuple[pd.DataFrame, pd.DataFrame]:
        """Closed versions, and the open one as a row. last: the row after them."""
        value, entity, item = rows["value"].to_numpy(), rows["entity"].to_numpy(), rows["item"].to_numpy()
        same = (entity[1:] == entity[:-1]) & (item[1:] == item[:-1])
        equal = same & ((value[1:] == value[:-1]) | (np.isnan(value[1:]) & np.isnan(value[:-1])))
        begin = np.flatnonzero(np.concatenate([[True], ~equal]))
        run = np.cumsum(np.concatenate([[0], ~equal]))
        latest = np.lexsort((rows["start"].to_numpy(), rows["seen"].to_numpy(), run))
        latest = latest[np.append(begin[1:], len(rows)) - 1]
        out = rows.iloc[begin].copy()
        out["seen"], out["until"] = rows["seen"].to_numpy()[latest], rows["until"].to_numpy()[latest]
        start = out["first"].to_numpy()
        follows = np.concatenate([(out["entity"].to_numpy()[1:] == out["entity"].to_numpy()[:-1]) & (out["item"].to_numpy()[1:] == out["item"].to_numpy()[:-1]), [False]])
        ends = out["until"].to_numpy().copy()
        ends[:-1] = np.where(follows[:-1], np.minimum(ends[:-1], start[1:] - 1), ends[:-1])
        out["ends"] = ends
        if last is not None and out["entity"].iloc[-1] == last["entity"] and out["item"].iloc[-1] == last["item"]:
            return out.iloc[:-1], out.iloc[-1:]
        return out, out.iloc[:0]

    def result(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"entity": x["entity"], "item": x["item"], "value": x["value"].replace({np.nan: None}), "valid_from": x["first"], "valid_to": x["ends"]})

    columns = ["entity", "item", "start", "first", "value", "seen", "until"]
    for batch in batches:
        if not len(batch):
            continue
        batch = batch.assign(first=batch["start"])[columns]
        rows = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
        again = np.ones(len(rows), dtype=bool)  # of the rows of one start, the last one counts
        again[:-1] = (
            (rows["entity"].to_numpy()[1:] != rows["entity"].to_numpy()[:-1])
            | (rows["item"].to_numpy()[1:] != rows["item"].to_numpy()[:-1])
            | (rows["start"].to_numpy()[1:] != rows["start"].to_numpy()[:-1])
        )
        rows = rows[again]
        last = rows.iloc[-1:]
        if len(rows) > 1:
            closed, opened = versions(rows.iloc[:-1], last.iloc[0])
            if len(closed):
                yield result(closed)
            kept = pd.concat([opened[columns], last], ignore_index=True)
        else:
            kept = last
    if kept is not None:
        yield result(versions(kept, None)[0])


def version_history(rows: DataFrame) -> DataFrame:
    """Versions (see VERSION_SCHEMA; days since the epoch) of rows (entity string, item int, start int, value double,
    seen long, until int).

    entity and item name what is observed, start is the day from which a row's value holds, seen when it was
    retrieved, until the last day as the row states it. Of rows with the same start but different values, those with
    the value seen last count (of equal times the larger value, no value being least); neighbours in order of start
    with equal values (also: no value) form one version. A version ends on the earlier of the day that its last seen
    row states (null: open) and the day before the next version. Rows without entity, item or start are left out; a
    null seen counts as earliest. Repeated rows change nothing; an empty table has no versions.
    """
    clean = rows.where("entity is not null and item is not null and start is not null").select(
        "entity",
        "item",
        "start",
        "value",
        F.coalesce("seen", F.lit(-(2**62))).alias("seen"),
        F.coalesce("until", F.lit(OPEN_END)).alias("until"),
    )
    reduced = (
        clean.groupBy("entity", "item", "start", "value")
        .agg(F.max(F.struct("seen", "until")).alias("last"))
        .select("entity", "item", "start", "value", "last.seen", "last.until")
    )
    ordered = reduced.repartition("entity", "item").sortWithinPartitions("entity", "item", "start", "seen", "value")
    return ordered.mapInPandas(_merge, VERSION_SCHEMA)
