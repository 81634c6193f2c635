"""Writing: append-only saves, upserts, ordered exports, and checks of lineage."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RecordConflict(ValueError):
    """A row with a known id but other content."""


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at a path, or None where there is nothing; a table that can't be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def append_only(rows: DataFrame, path: str, key: str, partition_by: list[str] | None = None) -> int:
    """Adds the rows whose key is not there yet and gives their number; equal rows are reused.

    Raises RecordConflict if a key is there, or comes twice, with other content; then nothing is written. Known rows
    are compared by digest, so that only keys and digests are joined; the conflicts and the new keys come from one join. One
    writer at a time: two that append at once don't see each other's rows.
    """
    columns = sorted(rows.columns)
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    new = rows.withColumn("__digest", digest).groupBy(key).agg(F.min("__digest").alias("__a"), F.max("__digest").alias("__b"), F.min(F.struct(*[c for c in columns if c != key])).alias("__row"))
    old = _existing(rows.sparkSession, path)
    if old is None:
        state = new.withColumn("__was", F.lit(None).cast("string"))
    else:
        known = old.select(F.col(key).alias("__key"), digest.alias("__was")).groupBy("__key").agg(F.max("__was").alias("__was"))
        state = new.join(known, new[key] == known["__key"], "left").drop("__key")
    twice, other, added = state.agg(F.count(F.when(F.col("__a") != F.col("__b"), 1)), F.count(F.when(F.col("__was") != F.col("__a"), 1)), F.count(F.when(F.col("__was").isNull(), 1))).first()
    if twice:
        raise RecordConflict(f"{path}: one key comes with different content")
    if other:
        raise RecordConflict(f"{path}: a known key comes with other content")
    if added:
        out = state.where(F.col("__was").isNull()).select(*[c if c == key else F.col(f"__row.{c}").alias(c) for c in rows.columns])
        writer = out.write.mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return added


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with the rows of new in place of those with the same key; of several new rows of a key the least one counts."""
    others = [c for c in new.columns if c != key]
    one = new.groupBy(key).agg(F.min(F.struct(*others)).alias("x")).select(key, "x.*")
    return old.join(one.select(key), key, "left_anti").unionByName(one)


def export(df: DataFrame, path: str, order: list[str], overwrite: bool = False) -> None:
    """A table sorted by its keys, range by range; an existing export is kept unless told otherwise."""
    df.orderBy(*order).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def export_text(df: DataFrame, path: str, form: str = "csv", overwrite: bool = False) -> None:
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    writer.option("header", "true").csv(path) if form == "csv" else writer.json(path)


def broken_lineage(child: DataFrame, inputs: str, parent: DataFrame, parent_key: str, child_key: str) -> DataFrame:
    """(child_key, missing) for inputs, single or listed, that are not among the parent's keys."""
    many = child.schema[inputs].dataType.typeName() == "array"
    ids = child.select(child_key, (F.explode(inputs) if many else F.col(inputs)).alias("missing")).where("missing is not null")
    return ids.join(parent.select(F.col(parent_key).alias("missing")).distinct(), "missing", "left_anti").select(child_key, "missing")


def restore(spark: SparkSession, backup: str, path: str, key: str) -> int:
    """Rows of a backup that the table at path lacks, added to it; their number. A row that differs is a RecordConflict."""
    return append_only(spark.read.parquet(backup), path, key)


def lineage_chain(steps: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(step, missing) for a chain of tables (rows, key, inputs), each of whose inputs must be keys of the table before it; the
    first one's inputs are not asked for."""
    out = None
    for n, ((parent, parent_key, _), (child, key, inputs)) in enumerate(zip(steps, steps[1:], strict=False)):
        one = broken_lineage(child, inputs, parent, parent_key, key).select(F.lit(n + 1).alias("step"), F.col(key).cast("string").alias("key"), F.col("missing").cast("string").alias("missing"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a chain has two tables at least")
    return out
