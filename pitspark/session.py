"""Session settings and table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a key list may be broadcast; beyond it the same step runs as a shuffled join.
BROADCAST_ROWS = 1_000_000


def local_session(cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("pitspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; timestamps without zone mean UTC and stay as they are read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Where a row was read: its file and its place in it.
ROW = "__row"


def numbered(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a test table, and in ROW where each row stands, which is the same whenever the table is read."""
    return table(spark, sf_dir, name).select(*columns, F.struct("_metadata.file_path", "_metadata.row_index").alias(ROW))


def micros_sql(column: str) -> str:
    """SQL for the microseconds since the epoch of a timestamp without zone, independent of the session's zone."""
    return (
        f"cast(datediff(cast(`{column}` as date), date'1970-01-01') as bigint) * 86400000000L"
        f" + cast(extract(HOUR from `{column}`) as bigint) * 3600000000L"
        f" + cast(extract(MINUTE from `{column}`) as bigint) * 60000000L"
        f" + cast(extract(SECOND from `{column}`) * 1000000 as bigint)"
    )
