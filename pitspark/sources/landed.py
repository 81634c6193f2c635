"""Landed provider responses as rows: JSON text in a column, parsed in the JVM with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TEXT = {"mode": "PERMISSIVE", "primitivesAsString": "true"}


def _number(x: Column) -> Column:
    return x.try_cast("double")


def array_rows(df: DataFrame, payload: str, path: str, names: list[str]) -> DataFrame:
    """Rows of an array of arrays at ``path`` of a payload, with their position; values as numbers.

    Numbers are read as text first, so that nothing is lost before the cast. Unreadable payloads, other shapes and null
    rows give no row; a missing value is null.
    """
    rows = F.from_json(F.get_json_object(payload, path), "array<array<string>>", _TEXT)
    out = df.select("*", F.posexplode(rows).alias("position", "__row")).where("__row is not null")
    return out.select(*df.columns, "position", *[_number(F.get("__row", k)).alias(n) for k, n in enumerate(names)])


def candles(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Candle arrays [time, low, high, open, close, volume]."""
    return array_rows(df, payload, "$", ["time_s", "low", "high", "open", "close", "volume"])


def volatility_points(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Volatility index arrays [epoch ms, open, high, low, close] of a response."""
    return array_rows(df, payload, "$.result.data", ["epoch_ms", "open", "high", "low", "close"])


BAR = "t string, o double, h double, l double, c double, v double, n double, vw double"
FUNDING = "timestamp long, index_price double, interest_1h double, interest_8h double, prev_index_price double"
SNAPSHOT = "series_id string, observation_date string, realtime_start date, realtime_end date, value string"


def objects(df: DataFrame, payload: str, path: str, schema: str) -> DataFrame:
    """Objects of an array at ``path``, typed; a field of another type is null."""
    fields = ", ".join(part.strip().replace(" ", ":", 1) for part in schema.split(","))
    rows = F.from_json(F.get_json_object(payload, path), f"array<struct<{fields}>>", {"mode": "PERMISSIVE"})
    out = df.select("*", F.posexplode(rows).alias("position", "__row")).where("__row is not null")
    return out.select(*df.columns, "position", "__row.*")


def bars(df: DataFrame, payload: str = "payload") -> DataFrame:
    return objects(df, payload, "$.bars", BAR)


def funding(df: DataFrame, payload: str = "payload") -> DataFrame:
    return objects(df, payload, "$.result", FUNDING)


def snapshots(df: DataFrame, payload: str = "payload") -> DataFrame:
    return objects(df, payload, "$.observations", SNAPSHOT)


FILING_COLUMNS = ["accessionNumber", "filingDate", "reportDate", "form", "acceptanceDateTime"]


def filing_index(df: DataFrame, payload: str = "payload", body: str = "$.body") -> DataFrame:
    """Filings of a submissions document, whose columns come as parallel arrays; empty texts are null."""
    none = F.array().cast("array<string>")  # a column that is left out has no values, rather than making the rows null
    columns = [F.coalesce(F.from_json(F.get_json_object(payload, f"{body}.filings.recent.{c}"), "array<string>"), none).alias(c) for c in FILING_COLUMNS]
    zipped = df.select(*df.columns, *columns).withColumn("__rows", F.arrays_zip(*FILING_COLUMNS))
    out = zipped.select(*df.columns, F.posexplode("__rows").alias("position", "f")).where("f.accessionNumber is not null")
    return out.select(*df.columns, "position", *[F.nullif(F.col(f"f.{c}"), F.lit("")).alias(c) for c in FILING_COLUMNS])


def company_facts(df: DataFrame, payload: str = "payload", body: str = "$.body") -> DataFrame:
    """Facts of a company document by taxonomy, tag and unit, with maps instead of a fixed schema."""
    fact = "array<struct<`end`:string,start:string,val:double,accn:string,form:string,filed:string,fy:int,fp:string,frame:string>>"
    facts = F.from_json(F.get_json_object(payload, f"{body}.facts"), f"map<string,map<string,struct<units:map<string,{fact}>>>>")
    a = df.select(*df.columns, F.explode(facts).alias("taxonomy", "__tags"))
    b = a.select(*df.columns, "taxonomy", F.explode("__tags").alias("tag", "__concept"))
    c = b.select(*df.columns, "taxonomy", "tag", F.explode("__concept.units").alias("unit", "__facts"))
    d = c.select(*df.columns, "taxonomy", "tag", "unit", F.posexplode("__facts").alias("position", "f")).where("f is not null")
    return d.select(*df.columns, "taxonomy", "tag", "unit", "position", "f.*")


def read_landed(spark, path: str, schema: str | None = None) -> DataFrame:
    """Landed JSON documents, one a file, with their path; with a schema they are parsed on reading."""
    if schema:
        return spark.read.schema(schema).option("multiLine", "true").json(path)
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("payload"))


def verified(records: DataFrame) -> DataFrame:
    """Raw records with whether their checksum is that of their payload."""
    return records.withColumn("verified", F.coalesce(F.sha2("payload", 256) == F.lower("checksum_sha256"), F.lit(False)))
