"""Point-in-time reading of revisioned rows: what was eligible at a cut, and which revision holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def eligible(df: DataFrame, known_at: Column, available: str = "available_at", event: str | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Rows that were available at the cut and, if given, whose event lies in [start, end)."""
    keep = F.col(available) <= known_at
    if event is not None:
        if start is not None:
            keep = keep & (F.col(event) >= start)
        if end is not None:
            keep = keep & (F.col(event) < end)
    return df.where(keep)


def latest_revision(df: DataFrame, keys: list[str], order: str, meaning: list[str], identity: str) -> DataFrame:
    """One row for each key: the revision with the greatest ``order``.

    meaning: the columns in which tied revisions must agree. Where they don't, ``ambiguous`` is true and the caller must
    not use the row; where they do, the smallest ``identity`` stands for all. ``revisions`` counts the rows of the key,
    ``superseded`` those before the latest moment. Done by aggregation with map-side combine, so a key with very many
    revisions is reduced before it moves; ties are compared by a digest of their meaning.
    """
    digest = F.xxhash64(*[F.col(c) for c in meaning])
    others = [c for c in df.columns if c not in keys and c not in (order, identity)]
    marked = df.where(F.col(order).isNotNull()).withColumn("__digest", digest)
    # the revisions of one moment first, then the moments of a key
    moments = marked.groupBy(*keys, order).agg(
        F.min("__digest").alias("__low"), F.max("__digest").alias("__high"), F.count(F.lit(1)).alias("__n"), F.min(F.struct(identity, *others)).alias("__row")
    )
    latest = moments.groupBy(*keys).agg(F.max(F.struct(order, "__low", "__high", "__n", "__row")).alias("x"), F.sum("__n").alias("revisions"))
    return latest.select(
        *keys,
        F.col(f"x.{order}").alias(order),
        F.col(f"x.__row.{identity}").alias(identity),
        *[F.col(f"x.__row.{c}").alias(c) for c in others],
        (F.col("x.__low") != F.col("x.__high")).alias("ambiguous"),
        "revisions",
        (F.col("revisions") - F.col("x.__n")).alias("superseded"),
    )


def require(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """df as it is; running it fails with the message if a row doesn't hold."""
    return df.where(F.assert_true(F.coalesce(holds, F.lit(False)), F.lit(message)).isNull())


def effective_cut(df: DataFrame, keys: list[str], known_at: Column, available: str = "available_at") -> DataFrame:
    """For each key the earliest moment at which all of its required evidence was there, and whether the cut is too early."""
    first = df.groupBy(*keys).agg(F.min(available).alias("earliest"))
    return first.withColumn("too_early", F.col("earliest") > known_at)


def best_known(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, known: str, block: int, rank: list[str], carry: list[str]) -> DataFrame:
    """left with the columns ``rank`` and ``carry`` of the greatest right row, by ``rank``, of its keys that was known at ``left_at``.

    known: the time, a number like left_at, from which a right row is known; with rank [known] this is the last row before
    a moment, with rank [event, known] the latest event as it was known then. Both sides are put on one line, and the
    greatest row so far is carried along it within blocks of time; that of all earlier blocks comes from one row a block.
    So neither side is paired with a range of the other, and a busy key is spread over its blocks. A left row before any
    right row keeps nulls.
    """
    bucket = lambda c: F.floor(F.col(c) / F.lit(float(block))).cast("long")
    others = [c for c in left.columns if c not in keys and c != left_at]
    r = right.where(F.col(known).isNotNull()).select(*keys, F.col(known).alias("__at"), F.struct(*dict.fromkeys([*rank, *carry])).alias("__value")).withColumn("__block", bucket("__at"))
    lines = left.select(*keys, F.col(left_at).alias("__at"), F.struct(*others).alias("__left")).withColumn("__block", bucket("__at"))
    none = F.lit(None).cast(r.schema["__value"].dataType)
    tops = r.groupBy(*keys, "__block").agg(F.max("__value").alias("__top"))
    blocks = lines.select(*keys, "__block").distinct().withColumn("__top", none).unionByName(tops).groupBy(*keys, "__block").agg(F.max("__top").alias("__top"))
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*keys, "__block", F.max("__top").over(before).alias("__carried"))
    both = lines.select(*keys, "__block", "__at", F.lit(1).alias("__side"), "__left", none.alias("__value")).unionByName(
        r.select(*keys, "__block", "__at", F.lit(0).alias("__side"), F.lit(None).cast(lines.schema["__left"].dataType).alias("__left"), "__value")
    )
    line = Window.partitionBy(*keys, "__block").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__own", F.max("__value").over(line)).where("__side = 1").join(carried, [*keys, "__block"], "left").withColumn("__got", F.greatest("__own", "__carried"))
    return found.select(*keys, F.col("__at").alias(left_at), *[F.col(f"__left.{c}").alias(c) for c in others], *[F.col(f"__got.{c}").alias(c) for c in dict.fromkeys([*rank, *carry])])


QUALITY = ["valid", "delayed", "partial", "suspect"]


def quality_rank(quality: Column) -> Column:
    """0 for valid up to 3 for suspect, so that the worst of a group is its maximum; null for anything else."""
    rank = F.lit(None).cast("int")
    for n, name in reversed(list(enumerate(QUALITY))):
        rank = F.when(quality == name, F.lit(n)).otherwise(rank)
    return rank


def quality_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(q) for q in QUALITY]), rank + 1)
