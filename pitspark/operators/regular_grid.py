"""Irregular readings onto a regular grid: counters differenced, increments shared out, gaps marked.

Which cells of a series hold a reading is kept as one bit a cell, 64 cells to a word, so that millions of readings
meet the expected grid as a few words and no series is ever brought to one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = 64


def _bits(first: Column, last: Column) -> Column:
    """A word with the bits first..last set (0..63, first <= last)."""
    ones = F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (F.lit(63) - (last - first)).cast("int"))
    return F.call_function("shiftleft", ones, first.cast("int"))


def _word(cell: Column) -> Column:
    return F.floor(cell / F.lit(float(WORD))).cast("long")


def presence(readings: DataFrame) -> DataFrame:
    """(series, step, word, present) of readings (series, step, cell): one bit for each cell that has a reading."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("cell"), F.lit(WORD)).cast("int"))
    return readings.where("series is not null and step is not null and cell is not null").groupBy("series", "step", _word(F.col("cell")).alias("word")).agg(F.bit_or(bit).alias("present"))


def expected(windows: DataFrame) -> DataFrame:
    """(series, step, word, wanted) of windows (series, step, first, last), cells counted inclusively; overlaps merge."""
    whole = windows.where("series is not null and step is not null and first <= last")
    words = whole.distinct().withColumn("word", F.explode(F.sequence(_word(F.col("first")), _word(F.col("last")))))
    base = F.col("word") * WORD
    mask = _bits(F.greatest(F.col("first") - base, F.lit(0)), F.least(F.col("last") - base, F.lit(WORD - 1)))
    return words.select("series", "step", "word", mask.alias("mask")).groupBy("series", "step", "word").agg(F.bit_or("mask").alias("wanted"))


def spans(present: DataFrame) -> DataFrame:
    """Windows (series, step, first, last) from each series' first to its last cell with a reading, of its words."""
    ends = present.groupBy("series", "step").agg(F.min(F.struct("word", "present")).alias("a"), F.max(F.struct("word", "present")).alias("b"))
    low, high = F.bin("a.present"), F.bin("b.present")
    first = F.col("a.word") * WORD + F.length(low) - F.length(F.rtrim(low, F.lit("0")))
    return ends.select("series", "step", first.alias("first"), (F.col("b.word") * WORD + F.length(high) - 1).alias("last"))


def grid(windows: DataFrame | None, readings: DataFrame) -> DataFrame:
    """(series, step, cell, covered) for every cell of the windows (none: from each series' first reading to its last);
    covered says whether a reading begins in it."""
    present = presence(readings)
    words = expected(spans(present) if windows is None else windows).join(present, ["series", "step", "word"], "left")
    return _cells(words.withColumn("present", F.coalesce("present", F.lit(0).cast("long"))), "wanted").select("series", "step", "cell", (F.getbit("present", F.col("bit")) == 1).alias("covered"))


def _cells(words: DataFrame, mask: str) -> DataFrame:
    opened = words.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))).where(F.getbit(mask, F.col("bit")) == 1)
    return opened.withColumn("cell", F.col("word") * WORD + F.col("bit"))


def counter_increments(readings: DataFrame, block: int) -> DataFrame:
    """(series, at, until, amount, reset) between consecutive readings (series, at long, value) of cumulative counters.

    A value below the one before it is a reset, after which the counter counts from zero. Of readings at one time the
    largest counts; readings with a null take no part. A series is worked on in blocks of time: the last reading of
    each earlier block is found from one row a block, so no series has to lie in one place.
    """
    one = readings.where("series is not null and at is not null and value is not null").groupBy("series", "at").agg(F.max("value").alias("value"))
    blocks = one.withColumn("block", F.floor(F.col("at") / F.lit(float(block))).cast("long"))
    lasts = blocks.groupBy("series", "block").agg(F.max(F.struct("at", "value")).alias("end"))
    before = lasts.select("series", "block", F.lag("end").over(Window.partitionBy("series").orderBy("block")).alias("carried"))
    line = Window.partitionBy("series", "block").orderBy("at")
    own = blocks.withColumn("own", F.lag(F.struct("at", "value")).over(line)).join(before, ["series", "block"], "left")
    pairs = own.withColumn("last", F.coalesce("own", "carried")).where("last is not null")
    reset = F.col("value") < F.col("last.value")
    return pairs.select(
        "series",
        F.col("last.at").alias("at"),
        F.col("at").alias("until"),
        F.when(reset, F.col("value")).otherwise(F.col("value") - F.col("last.value")).alias("amount"),
        reset.alias("reset"),
    )


def distribute(increments: DataFrame) -> DataFrame:
    """(series, step, cell, amount) of increments (series, step, at, until, amount; at < until) shared out among the
    cells they overlap, in proportion to the overlap."""
    whole = increments.where("series is not null and step > 0 and at < until and amount is not null")
    last = F.floor((F.col("until") - 1) / F.col("step"))
    cells = whole.withColumn("cell", F.explode(F.sequence(F.floor(F.col("at") / F.col("step")), last)))
    overlap = F.least(F.col("until"), (F.col("cell") + 1) * F.col("step")) - F.greatest(F.col("at"), F.col("cell") * F.col("step"))
    return cells.groupBy("series", "step", "cell").agg(F.sum(F.col("amount") * overlap / (F.col("until") - F.col("at"))).alias("amount"))


def regular_series(windows: DataFrame | None, readings: DataFrame, increments: DataFrame) -> DataFrame:
    """(series, step, cell, covered, amount) for every cell of the windows (none: from each series' first reading to its
    last): its share of the increments, and whether a reading begins in it; the amount of a cell that nothing reaches is
    null, never zero. Null series, steps and cells take no part; a reading delivered twice sets the same bit; windows may
    overlap, and one that ends before it begins has no cells."""
    return grid(windows, readings).join(distribute(increments), ["series", "step", "cell"], "left")
