"""Pairs of records nearest in time: tolerance-width buckets, same or adjacent, then the minimum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_in_time(left: DataFrame, right: DataFrame, tolerance: int) -> DataFrame:
    """(left_id, right_id) for each row of left (left_id, entity, at long) that has a row of right (right_id, entity,
    at long) of the same entity at most ``tolerance`` away, with the nearest one.

    Of equally near rows the earlier one counts, then the one with the smaller id; the bound is inclusive. Rows with a
    null take no part; a left_id delivered twice gives one pair, and right rows of one moment are reduced to the
    smallest id before they move. The join is on entity and bucket, so an entity with many rows is spread over its
    buckets.
    """
    if tolerance <= 0:
        raise ValueError("tolerance must be positive")
    width = F.lit(float(tolerance))
    bucket = F.floor(F.col("at") / width).cast("long")
    there = right.where("right_id is not null and entity is not null and at is not null").groupBy("entity", "at").agg(F.min("right_id").alias("right_id"))
    theirs = there.select(F.col("entity").alias("e"), F.col("at").alias("then"), "right_id", bucket.alias("b"))
    mine = left.where("left_id is not null and entity is not null and at is not null").select(
        "left_id", "entity", "at", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket")
    )
    away = F.abs(F.col("then") - F.col("at"))
    near = mine.join(theirs, (F.col("entity") == F.col("e")) & (F.col("bucket") == F.col("b")) & (away <= tolerance))
    best = F.min(F.struct(away.alias("away"), "then", "right_id"))
    return near.groupBy("left_id").agg(best.alias("best")).select("left_id", F.col("best.right_id").alias("right_id"))
