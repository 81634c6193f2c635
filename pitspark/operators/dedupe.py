"""One row per key without moving wide rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.session import BROADCAST_ROWS, ROW


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """df with one row for each value of the keys (nulls count as a value).

    Where df has the column ROW (see ``session.numbered``), which says where a row was read, the first row of a repeated
    key stays. The repeated keys are found from the keys and places alone; the wide columns are read once and not moved.
    The list of repeated keys is counted, broadcast if it is small enough, and joined by shuffling otherwise. Without
    that column the rows move to their keys, and of several rows the least one stays.
    """
    others = [c for c in df.columns if c not in (*keys, ROW)]
    if ROW not in df.columns:
        return df.groupBy(*keys).agg(F.min(F.struct(*others)).alias("x")).select(*[c if c in keys else F.col(f"x.{c}").alias(c) for c in df.columns]) if others else df.distinct()
    names = [f"__k{n}" for n in range(len(keys))]
    repeated = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.count(F.lit(1)).alias("__n"), F.min(ROW).alias("__first")).where("__n > 1").drop("__n")
    if repeated.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    same = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        same = same & df[k].eqNullSafe(repeated[n])
    return df.join(repeated, same, "left").where(F.col("__first").isNull() | (F.col("__first") == F.col(ROW))).drop(ROW, "__first", *names)
