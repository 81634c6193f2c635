"""Queries of the operators in this subpackage, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitspark.llm.abuse import flagged, rates, scores
from pitspark.llm.encode import decode_corpus, encode_corpus
from pitspark.llm.leaks import leaks, without_leaks
from pitspark.llm.nearest import nearest_in_time
from pitspark.operators.normalise_times import with_instant
from pitspark.plans.instant_sql import instants
from pitspark.session import micros_sql, numbered, table

FUNDING_TOLERANCE_MS = 20 * 60 * 1000
CANDLE_TOLERANCE_MICROS = 90 * 1_000_000


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    summaries = table(spark, sf_dir, "perpetual_summaries").where("creation_timestamp is not null and instrument_name is not null")
    funding = with_instant(table(spark, sf_dir, "funding_history").select("funding_id", "instrument_name", "feed", "funding_timestamp"), "funding_timestamp", "feed", table(spark, sf_dir, "feed_zones"))
    to_funding = nearest_in_time(
        summaries.select(F.col("summary_id").alias("left_id"), F.col("instrument_name").alias("entity"), F.col("creation_timestamp").alias("at")),
        funding.select(F.col("funding_id").alias("right_id"), F.col("instrument_name").alias("entity"), F.col("utc_ms").alias("at")),
        FUNDING_TOLERANCE_MS,
    )
    product = F.concat(F.regexp_extract("instrument_name", "^(.*)-PERPETUAL$", 1), F.lit("-USD"))
    to_candles = nearest_in_time(
        summaries.where("instrument_name like '%-PERPETUAL'").select(F.col("summary_id").alias("left_id"), product.alias("entity"), (F.col("creation_timestamp") * 1000).alias("at")),
        table(spark, sf_dir, "spot_candles").select(F.col("candle_id").alias("right_id"), F.col("product_id").alias("entity"), F.expr(micros_sql("candle_start")).alias("at")),
        CANDLE_TOLERANCE_MICROS,
    )
    named = lambda df, name: df.select(F.col("left_id").alias("summary_id"), F.lit(name).alias("other_table"), F.col("right_id").alias("other_id"))
    return named(to_funding, "funding_history").unionAll(named(to_candles, "spot_candles"))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(numbered(spark, sf_dir, "documents", "doc_id", "text"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document decoded from its ids: characters, bytes and a digest of the text that comes back."""
    text = decode_corpus(p8_ids(spark, sf_dir))
    return text.select("doc_id", F.length("text").cast("long").alias("chars"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("digest"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p9_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaking documents with the leaked spans removed."""
    return without_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(table(spark, sf_dir, "documents"))


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, and the weight of each kind of language in it."""
    return scores(table(spark, sf_dir, "documents"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, flagged ones and their rate for each source."""
    return rates(table(spark, sf_dir, "documents"))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates, "p2_found": p2_found, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_found": p9_found, "p9_cleaned": p9_cleaned}
SQL: dict[str, str] = {
    "p2_found": "with " + instants("i", "select distinct funding_id as id, funding_timestamp as t, feed from funding_history") + """,
        s as (select distinct summary_id, instrument_name, creation_timestamp as made from perpetual_summaries where creation_timestamp is not null and instrument_name is not null and summary_id is not null),
        f as (select distinct f.funding_id, f.instrument_name, i.ms from funding_history f join i on i.id = f.funding_id where i.ms is not null),
        a as (select summary_id, funding_id as other_id, row_number() over (partition by summary_id order by abs(ms - made), ms, funding_id) as k from s join f on s.instrument_name = f.instrument_name and f.ms between s.made - 1200000 and s.made + 1200000),
        c as (select distinct candle_id, product_id, epoch_us(candle_start) as us from spot_candles where candle_id is not null and candle_start is not null),
        b as (select summary_id, candle_id as other_id, row_number() over (partition by summary_id order by abs(us - made * 1000), us, candle_id) as k from s join c on c.product_id = regexp_extract(instrument_name, '^(.*)-PERPETUAL$', 1) || '-USD' and c.us between s.made * 1000 - 90000000 and s.made * 1000 + 90000000)
        select summary_id, 'funding_history' as other_table, other_id from a where k = 1 union all select summary_id, 'spot_candles', other_id from b where k = 1""",
    "p8_round_trip": "select doc_id, length(t) as chars, strlen(t) as bytes, sha256(t) as digest from (select distinct doc_id, coalesce(text, '') as t from documents where doc_id is not null) d",
}
