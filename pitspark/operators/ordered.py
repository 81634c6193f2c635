"""Row frames over long sequences without one task for one sequence.

Rows get their index in the sequence from counts of blocks of time, and are then cut into parts of equal length; each
part also gets the rows that its first frame reaches back to. Frames and recursions are exact, and a key that holds a
third of all rows is spread over as many parts as it needs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows in a part. Bounded so that the powers of a recursion's factor stay within a double.
PART = 512


def index_rows(df: DataFrame, keys: list[str], at: str, block: int, ties: list[str] | None = None) -> DataFrame:
    """df with ``rn``, the 0-based place of a row among its keys' rows in order of ``at`` (a number), then ``ties``."""
    cut = df.withColumn("__block", F.floor(F.col(at) / F.lit(float(block))).cast("long"))
    sizes = cut.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    line = Window.partitionBy(*keys, "__block").orderBy(at, *(ties or []))
    ranked = cut.withColumn("__k", F.row_number().over(line))
    return ranked.join(starts, [*keys, "__block"]).withColumn("rn", F.col("__start") + F.col("__k") - 1).drop("__block", "__k", "__start")


def with_halo(df: DataFrame, before: int, part: int = PART) -> DataFrame:
    """df (with rn) cut into parts: ``part`` numbers them, ``halo`` marks rows repeated from the part before."""
    own = F.floor(F.col("rn") / F.lit(float(part))).cast("long")
    if before > part:
        part = before
        own = F.floor(F.col("rn") / F.lit(float(part))).cast("long")
    tail = F.pmod(F.col("rn"), F.lit(part)) >= part - before
    copies = F.when(tail, F.array(F.struct(own.alias("part"), F.lit(False).alias("halo")), F.struct((own + 1).alias("part"), F.lit(True).alias("halo")))).otherwise(
        F.array(F.struct(own.alias("part"), F.lit(False).alias("halo")))
    )
    return df.withColumn("__c", F.explode(copies)).withColumns({"part": F.col("__c.part"), "halo": F.col("__c.halo")}).drop("__c")


def rolling(df: DataFrame, keys: list[str], before: int, columns: dict[str, Column]) -> DataFrame:
    """df (with rn) and columns whose frames reach at most ``before`` rows back; build them with ``frame``."""
    wide = with_halo(df, before)
    return wide.withColumns(columns).where("not halo").drop("part", "halo")


def frame(keys: list[str], first: int | None = None, last: int = 0):
    """The window of a rolling column: rows first..last relative to the row (None: an ordered window for lag)."""
    line = Window.partitionBy(*keys, "part").orderBy("rn")
    return line if first is None else line.rowsBetween(first, last)


def _fading(factor: float):
    return lambda so_far, x: so_far * F.lit(factor) + x


def decayed_sums(df: DataFrame, keys: list[str], sums: list[tuple[str, str, float]], part: int = PART) -> DataFrame:
    """df (with rn) and for each (value, out, decay) ``out``: the sum over all rows up to this one of value * decay **
    distance, nulls adding nothing.

    Within a part a sum is a scaled running sum; the parts before it add their own totals, decayed, as far back as
    they still count in a double. All sums share one cut, one window and one join.
    """
    if not all(0 < decay < 1 for *_, decay in sums):
        raise ValueError("decay must lie between 0 and 1")
    part = max(2, min(part, *(int(280 / -math.log10(decay)) for *_, decay in sums)))
    cut = df.withColumns({"__part": F.floor(F.col("rn") / F.lit(float(part))).cast("long"), "__i": F.pmod(F.col("rn"), F.lit(part)).cast("int")})
    line = Window.partitionBy(*keys, "__part").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    parts = Window.partitionBy(*keys).orderBy("__part")
    local, totals, carried, out = {}, [], {}, {}
    for k, (value, name, decay) in enumerate(sums):
        log = math.log(decay)
        scaled = F.coalesce(F.col(value), F.lit(0.0)) * F.exp(-F.col("__i") * F.lit(log))
        local[f"__local{k}"] = F.sum(scaled).over(line) * F.exp(F.col("__i") * F.lit(log))
        totals.append((F.sum(scaled) * F.lit(math.exp(log * (part - 1)))).alias(f"__total{k}"))
        # parts have no gaps: every part before the last is full
        recent = F.collect_list(f"__total{k}").over(parts.rowsBetween(-max(1, math.ceil(math.log(1e-18) / (log * part))), -1))
        carried[f"__carried{k}"] = F.aggregate(recent, F.lit(0.0), _fading(math.exp(log * part)))
        out[name] = F.col(f"__local{k}") + F.col(f"__carried{k}") * F.exp((F.col("__i") + 1) * F.lit(log))
    before = cut.groupBy(*keys, "__part").agg(*totals).select(*keys, "__part", *[c.alias(n) for n, c in carried.items()])
    return cut.withColumns(local).join(before, [*keys, "__part"]).withColumns(out).drop("__part", "__i", *local, *carried)


def decayed_sum(df: DataFrame, keys: list[str], value: str, out: str, decay: float, part: int = PART) -> DataFrame:
    return decayed_sums(df, keys, [(value, out, decay)], part)
