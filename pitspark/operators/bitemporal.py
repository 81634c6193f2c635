"""Attributes as they were known at an event: disjoint rectangles of valid and recorded time, indexed by a grid.

For each entity and attribute the plane of valid time (days) and recorded time (microseconds) is split into
rectangles in each of which one fact is the current one. An event is a point of that plane, and finding its facts
means locating it: rectangles and points meet in the cells of a coarse grid, and a point lies in at most one
rectangle of each attribute.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ends of open rectangles.
OPEN_DAY, OPEN_MICROS = 2**31 - 1, 2**63 - 1
#: Sides of a grid cell.
CELL_DAYS, CELL_MICROS = 730, 730 * 86_400_000_000
#: A rectangle that reaches this many cells beyond its first lies in the coarse level of that direction, whose one cell is EVERY.
LONG, EVERY = 2, -(2**31)

_SEGMENTS = "entity string, attribute string, day int, known long, day_end int"


def _sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (entity, attribute, day, known) sorted by entity, attribute, known: from when a day's facts hold until
    which day. Holds the distinct days of one attribute, of which the calendar has few."""
    key, days = None, []
    for batch in batches:
        out = []
        for entity, attribute, day, known in zip(batch["entity"], batch["attribute"], batch["day"].tolist(), batch["known"].tolist(), strict=True):
            if (entity, attribute) != key:
                key, days = (entity, attribute), []
            at = bisect_left(days, day)
            out.append((entity, attribute, day, known, days[at] if at < len(days) else OPEN_DAY))
            if at:
                out.append((entity, attribute, days[at - 1], known, day))
            insort(days, day)
        if out:
            yield pd.DataFrame(out, columns=["entity", "attribute", "day", "known", "day_end"])


def rectangles(facts: DataFrame) -> DataFrame:
    """Disjoint rectangles (entity, attribute, fact_id, day, day_end, known, known_end) of facts (entity, attribute,
    fact_id, period_end as microseconds, known as microseconds); days are those of period_end, ends are exclusive.

    In a rectangle the fact with the latest period_end, then the latest known, then the smallest id is current. Facts
    with a null in any of these columns never are. Facts delivered twice count once; other columns are ignored.
    """
    place = ["entity", "attribute", "day"]
    valid = facts.where("entity is not null and attribute is not null and fact_id is not null and period_end is not null and known is not null")
    first = (
        valid.select("entity", "attribute", F.expr("cast(floor(period_end / 86400000000D) as int)").alias("day"), "known", F.struct((-F.col("period_end")).alias("back"), "fact_id").alias("own"))
        .groupBy(*place, "known")
        .agg(F.min("own").alias("own"))
    )
    earlier = Window.partitionBy(*place).orderBy("known").rowsBetween(Window.unboundedPreceding, -1)
    # a fact recorded later takes over only if its period ends no earlier than those known on the same day
    current = first.withColumn("best", F.min("own.back").over(earlier)).where("best is null or own.back <= best").select(*place, "known", F.col("own.fact_id").alias("fact_id"))
    # the id goes along, so that both readers of the windows ask for the same exchange
    opened = current.groupBy(*place).agg(F.min(F.struct("known", "fact_id")).alias("o")).select(*place, "o.known")
    swept = opened.repartition("entity", "attribute").sortWithinPartitions("entity", "attribute", "known", "day").mapInPandas(_sweep, _SEGMENTS)
    events = current.select(*place, "known", "fact_id", F.lit(None).cast("int").alias("day_end")).unionByName(swept.withColumn("fact_id", F.lit(None).cast("string")))
    merged = events.repartition(*place).groupBy(*place, "known").agg(F.max("fact_id").alias("fact_id"), F.min("day_end").alias("day_end"))
    line = Window.partitionBy(*place).orderBy("known")
    return merged.select(
        "entity",
        "attribute",
        F.last("fact_id", ignorenulls=True).over(line).alias("fact_id"),
        "day",
        F.last("day_end", ignorenulls=True).over(line).alias("day_end"),
        "known",
        F.coalesce(F.lead("known").over(line), F.lit(OPEN_MICROS)).alias("known_end"),
    )


def locate(points: DataFrame, regions: DataFrame) -> DataFrame:
    """(point_id, attribute, fact_id) for points (point_id, entity, at_day int, at_micros long) in rectangles.

    Points with a null lie nowhere. The grid has four levels: cells, strips of all days or of all recorded times for
    rectangles that are long in that direction, and the whole plane for those long in both, of which an attribute has
    few. So a rectangle has at most nine copies, wherever it ends and whatever the points are. A point is looked up once
    in each level. A busy entity is met in many cells, and the join on entity and cell may be split further at run time.
    """
    whole = points.where("point_id is not null and entity is not null and at_day is not null and at_micros is not null")
    near = regions.where((F.col("day") < F.col("day_end")) & (F.col("known") < F.col("known_end")))
    cell = lambda c, size: F.floor(c / F.lit(float(size))).cast("int")
    every = F.lit(EVERY).cast("int")

    def cells(first: str, end: str, size: int) -> Column:
        a, b = cell(F.col(first), size), cell(F.col(end) - 1, size)
        return F.explode(F.when(b - a >= LONG, F.array(every)).otherwise(F.sequence(a, F.least(b, a + LONG))))

    indexed = near.withColumn("cell_day", cells("day", "day_end", CELL_DAYS)).withColumn("cell_known", cells("known", "known_end", CELL_MICROS))
    cd, ck = cell(F.col("at_day"), CELL_DAYS), cell(F.col("at_micros"), CELL_MICROS)
    levels = F.array(*[F.struct(d.alias("cd"), k.alias("ck")) for d, k in ((cd, ck), (every, ck), (cd, every), (every, every))])
    at = whole.select("point_id", F.col("entity").alias("e"), "at_day", "at_micros", F.explode(levels).alias("c")).select("point_id", "e", "at_day", "at_micros", "c.cd", "c.ck")
    inside = (
        (F.col("e") == F.col("entity"))
        & (F.col("cd") == F.col("cell_day"))
        & (F.col("ck") == F.col("cell_known"))
        & (F.col("at_day") >= F.col("day"))
        & (F.col("at_day") < F.col("day_end"))
        & (F.col("at_micros") >= F.col("known"))
        & (F.col("at_micros") < F.col("known_end"))
    )
    return at.join(indexed, inside).select("point_id", "attribute", "fact_id")
