"""Reading stored rows by criteria that all reach the scan, and by id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFound(KeyError):
    """An id that is asked for is not there."""


def scan(rows: DataFrame, equal: Mapping[str, object] | None = None, among: Mapping[str, Sequence] | None = None, at_least: Mapping[str, object] | None = None, at_most: Mapping[str, object] | None = None,
         before: Mapping[str, object] | None = None, not_null: Sequence[str] = (), parameters: Mapping[str, str] | None = None, parameters_in: str = "parameters", matching: Mapping[str, str] | None = None) -> DataFrame:
    """rows that meet all criteria, by column: equal values, membership (of an empty list: none), closed lower and upper
    bounds, an open upper bound, presence, name-value pairs of a JSON column, and regular expressions. A null meets none.
    """
    keep: list[Column] = [F.col(c).isNotNull() for c in not_null]
    value = lambda v: F.lit(v).cast("timestamp_ntz") if isinstance(v, datetime) and v.tzinfo is None else F.lit(v)
    keep += [F.col(c) == value(v) for c, v in (equal or {}).items()]
    keep += [F.col(c).isin(list(v)) if len(v) else F.lit(False) for c, v in (among or {}).items()]
    keep += [F.col(c) >= value(v) for c, v in (at_least or {}).items()]
    keep += [F.col(c) <= value(v) for c, v in (at_most or {}).items()]
    keep += [F.col(c) < value(v) for c, v in (before or {}).items()]
    keep += [F.get_json_object(parameters_in, f"$.{k}") == v for k, v in (parameters or {}).items()]
    keep += [F.col(c).rlike(v) for c, v in (matching or {}).items()]
    for one in keep:
        rows = rows.where(one)
    return rows


def get(rows: DataFrame, key: str, value: object) -> dict:
    """The row with an id; NotFound if there is none, ValueError if rows with that id differ."""
    found = rows.where(F.col(key) == F.lit(value)).distinct().limit(2).collect()
    if not found:
        raise NotFound(value)
    if len(found) > 1:
        raise ValueError(f"{key} {value!r} stands for different rows")
    return found[0].asDict()


def bulk_get(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows of the ids (a DataFrame with the column key), and found = false with nulls where there is none."""
    asked = ids.select(key).where(F.col(key).isNotNull()).distinct()
    return asked.join(rows.distinct().withColumn("__there", F.lit(True)), key, "left").withColumn("found", F.coalesce("__there", F.lit(False))).drop("__there")


def of_days(rows: DataFrame, column: str, first: date, last: date) -> DataFrame:
    """rows whose time lies in the days first..last."""
    return rows.where((F.col(column) >= F.lit(first).cast("timestamp_ntz")) & (F.col(column) < F.date_add(F.lit(last), 1).cast("timestamp_ntz")))
