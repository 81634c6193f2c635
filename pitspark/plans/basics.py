"""Queries for scans, predicates, set operations, top-k, scalar functions and landed documents."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitspark.functions.scalars import canonical_json, checksum, clamp, day_bounds, isin_is_valid, name_key, number_or_null, pad_cik, uuid5
from pitspark.operators.bars import resample
from pitspark.operators.pit import require
from pitspark.operators.scans import bulk_get, scan
from pitspark.operators.shred import shred, table_of
from pitspark.plans.fundamentals import FACTS_KNOWN_AT
from pitspark.plans.market import _BARS, _calendar, der_funding_windows, revised
from pitspark.plans.market import SQL as MARKET_SQL
from pitspark.plans.payload_sql import FACTS, OPENED
from pitspark.sources.landed import verified
from pitspark.sources.stores import broken_lineage
from pitspark.session import micros_sql, numbered, table

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def scan_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality, list, range, presence, parameter and pattern predicates together; all but the parameters reach the scan."""
    when = lambda x: datetime.fromisoformat(x)
    found = scan(
        table(spark, sf_dir, "observations"), equal={"frequency": "annual", "quality": "valid", "unit": "USD"}, among={"field_name": ["fundamental.revenue", "fundamental.net_income"]},
        at_least={"period_end": when("2016-01-01 00:00:00"), "available_at": when("2016-01-01 00:00:00"), "accepted_at": when("2016-01-01 00:00:00")}, at_most={"period_end": when("2020-12-31 23:59:59"), "available_at": when("2024-01-01 00:00:00")},
        before={"normalized_at": when("2025-01-01 00:00:00")}, not_null=["asset_id", "observation_id"], parameters={"form": "10-K"}, parameters_in="record_key", matching={"source_id": "^sec-"},
    )
    return found.select("observation_id", "asset_id", "field_name", "obs_value").distinct()


def scan_bulk_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records that observations name, and those that are not there."""
    named = table(spark, sf_dir, "observations").select(F.col("raw_record_id").alias("record_id"))
    return bulk_get(table(spark, sf_dir, "raw_records").select("record_id", "source_id", "received_at"), "record_id", named)


def scan_empty_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list predicate without members holds for no row."""
    wanted: list[str] = []
    o = table(spark, sf_dir, "observations")
    return o.where(F.col("field_name").isin(*wanted) if wanted else F.lit(False)).select("observation_id")


def scan_day_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive days as a half-open range of event times."""
    first, end = day_bounds(F.lit("2024-01-05").cast("date"), F.lit("2024-01-07").cast("date"))
    e = table(spark, sf_dir, "events")
    return e.where((F.col("ts") >= first) & (F.col("ts") < end)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


def agg_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct ids and edges of a table by group."""
    o = table(spark, sf_dir, "observations")
    return o.groupBy("field_name", "frequency").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("observation_id").alias("ids"), F.min("available_at").alias("first_available"), F.max("available_at").alias("last_available"))


def top_last_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three annual periods of each asset."""
    p = table(spark, sf_dir, "observations").where("frequency = 'annual' and asset_id is not null and period_end is not null").select("asset_id", F.to_date("period_end").alias("period")).distinct()
    rank = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("period")))
    return p.withColumn("place", rank).where("place <= 3")


def top_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty summaries created last, newest first."""
    s = table(spark, sf_dir, "perpetual_summaries").where("creation_timestamp is not null").select("summary_id", "instrument_name", "creation_timestamp").distinct()
    return s.orderBy(F.desc("creation_timestamp"), "summary_id").limit(50)


def top_whole_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last whole weeks of each product whose days fit a budget of twenty, and at least one week."""
    weeks = resample(_days(spark, sf_dir), ["product_id"], F.trunc("bucket", "week"), "bucket").select("product_id", F.col("bucket").alias("week"), "members")
    used = F.sum("members").over(Window.partitionBy("product_id").orderBy(F.desc("week")).rowsBetween(Window.unboundedPreceding, 0))
    place = F.row_number().over(Window.partitionBy("product_id").orderBy(F.desc("week")))
    return weeks.withColumns({"used": used, "place": place}).where("used <= 20 or place = 1").select("product_id", "week", "members", "used")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calendar(spark, sf_dir, "day").select("product_id", "bucket", "open", "high", "low", "close", "volume")


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets asked for, with facts, and either or both, by name of the set."""
    asked = table(spark, sf_dir, "valuation_requests").select("asset_id").where("asset_id is not null").distinct()
    known = table(spark, sf_dir, "observations").select("asset_id").where("asset_id is not null").distinct()
    named = lambda df, n: df.select(F.lit(n).alias("name"), "asset_id")
    return named(asked.union(known).distinct(), "union").unionAll(named(asked.intersect(known), "both")).unionAll(named(asked.subtract(known), "asked_only")).unionAll(named(known.subtract(asked), "known_only"))


def join_resolve_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings whose padded key stands for more than one asset, or for one, by asset key."""
    f = table(spark, sf_dir, "sec_filings").select(pad_cik(F.col("cik")).alias("key"), "asset_id").where("key is not null and asset_id is not null")
    return f.groupBy("key").agg(F.count_distinct("asset_id").alias("assets"), F.min("asset_id").alias("asset_id"), F.count(F.lit(1)).alias("filings")).withColumn("ambiguous", F.col("assets") > 1)


def join_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products that were imported and products that were only delivered."""
    c = table(spark, sf_dir, "spot_candles").select("product_id").where("product_id is not null").distinct()
    r = table(spark, sf_dir, "import_summaries").select("product_id").distinct()
    return c.join(r, "product_id", "left_semi").select("product_id", F.lit(True).alias("imported")).unionAll(c.join(r, "product_id", "left_anti").select("product_id", F.lit(False).alias("imported")))


def src_volatility_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = numbered(spark, sf_dir, "raw_records", "record_id", "source_id", "payload").where("source_id = 'deribit-dvol'")
    return table_of(shred(r), "point").select("record_id", F.col("item_no").alias("position"), "epoch_ms", "open", "close")


def src_filing_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings with an accession number; empty texts are null."""
    r = numbered(spark, sf_dir, "raw_records", "record_id", "source_id", "payload").where("source_id = 'sec-submissions'")
    own = lambda c: F.nullif(F.col(c), F.lit(""))
    return table_of(shred(r), "filing").select("record_id", F.col("item_no").alias("position"), F.col("accessionNumber").alias("accession"), own("filingDate").alias("filed"), own("form").alias("form"))


def src_company_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of all readable documents, also of those whose body is JSON text or whose unit holds one fact in place of a list."""
    r = numbered(spark, sf_dir, "raw_records", "record_id", "source_id", "payload").where("source_id = 'sec-companyfacts'")
    return table_of(shred(r), "fact").select("record_id", F.col("level1").alias("taxonomy"), F.col("level2").alias("tag"), F.col("level3").alias("unit"), F.col("item_no").alias("position"), "val", "accn")


def src_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "raw_records").where("payload is not null")).groupBy("source_id").agg(F.count(F.lit(1)).alias("records"), F.sum(F.col("verified").cast("long")).alias("verified"))


def sink_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items without an order, orders without a customer: how many ids break."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_orderkey").alias("of")).distinct()
    o = table(spark, sf_dir, "orders")
    a = broken_lineage(li, "of", o, "o_orderkey", "l_orderkey").agg(F.count(F.lit(1)).alias("broken")).select(F.lit("lineitem").alias("child"), "broken")
    b = broken_lineage(o.withColumn("of", F.col("o_custkey")), "of", table(spark, sf_dir, "customer"), "c_custkey", "o_orderkey").agg(F.count(F.lit(1)).alias("broken")).select(F.lit("orders").alias("child"), "broken")
    return a.unionAll(b)


def fn_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "sec_filings").select("filing_id", "accession_number", "asset_id", "cik", "form").distinct()
    return d.select(
        "filing_id", pad_cik(F.col("cik")).alias("padded"), checksum(F.col("accession_number")).alias("checksum"), name_key(F.concat_ws(" ", F.lit(" Ñandú &"), "form")).alias("name_key"),
        clamp(F.col("filing_id") / 100.0, 1.0, 5.0).alias("clamped"),
    )


def fn_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "macro_vintages").select("vintage_row_id", "raw_value").distinct()
    return m.select("vintage_row_id", F.round(number_or_null(F.col("raw_value")), 4).alias("number"))


def fn_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name-based ids of canonical JSON; ids are made of words, so both are checked by tests."""
    f = table(spark, sf_dir, "sec_filings").select("filing_id", "accession_number", "form").distinct()
    text = canonical_json(form=F.col("form"), accession=F.col("accession_number"))
    return f.select("filing_id", text.alias("text"), uuid5(NAMESPACE, text).alias("identity"))


def fn_isin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes made from part keys, with all ten check digits: exactly one is right."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("digit"))
    code = F.concat(F.lit("US"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.col("digit").cast("string"))
    return p.withColumn("fits", isin_is_valid(code)).groupBy("p_partkey").agg(F.sum(F.col("fits").cast("long")).alias("fits"))


def check_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that must hold; a row that doesn't would fail the run."""
    held = require(revised(spark, sf_dir), (F.col("low") <= F.col("high")) & (F.col("volume") >= 0), "a bar is inconsistent")
    return held.groupBy("product_id").agg(F.count(F.lit(1)).alias("bars"))


def plan_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each product what a next import has to fetch: from its last candle, or from where its runs began."""
    runs = table(spark, sf_dir, "import_summaries").groupBy("product_id").agg(F.min(F.expr(micros_sql("requested_start"))).alias("begins"), F.max(F.expr(micros_sql("requested_end"))).alias("ends"))
    last = revised(spark, sf_dir).groupBy("product_id").agg(F.max("at_us").alias("last_us"))
    out = runs.join(last, "product_id", "left")
    return out.select("product_id", "begins", "ends", F.coalesce("last_us", "begins").alias("fetch_from"), F.when(F.col("last_us").isNull(), "initial").when(F.col("last_us") >= F.col("ends"), "current").otherwise("incremental").alias("mode"))


def join_fact_filing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each fact's filing says of it: by accession number, then whether asset, form and period agree and it was filed by then."""
    o = table(spark, sf_dir, "observations").where("observation_id is not null").select(
        "observation_id", F.get_json_object("record_key", "$.accn").alias("accn"), F.get_json_object("record_key", "$.form").alias("fact_form"), F.col("asset_id").alias("fact_asset"), F.to_date("period_end").alias("period"), F.col("available_at").cast("date").alias("seen")
    ).distinct()
    f = table(spark, sf_dir, "sec_filings").where("accession_number is not null").groupBy(F.col("accession_number").alias("accn")).agg(
        F.min(F.struct("asset_id", "form", "report_date", "filing_date")).alias("a"), F.max(F.struct("asset_id", "form", "report_date", "filing_date")).alias("b")
    )
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    state = (
        F.when(F.col("a").isNull(), "no_filing").when(~F.col("a").eqNullSafe(F.col("b")), "contradictory_filing").when(~same(F.col("fact_asset"), F.col("a.asset_id")), "other_asset")
        .when(~same(F.col("fact_form"), F.col("a.form")), "other_form").when(~same(F.col("period"), F.col("a.report_date")), "other_period").when(~F.coalesce(F.col("seen") >= F.col("a.filing_date"), F.lit(False)), "before_filing").otherwise("agrees")
    )
    return o.join(f, "accn", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("facts"))


def join_traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each observation's record is there and agrees with it in asset, source and availability, by source."""
    o = table(spark, sf_dir, "observations").where("observation_id is not null").select("observation_id", F.col("raw_record_id").alias("record_id"), "asset_id", "source_id", "available_at").distinct()
    r = table(spark, sf_dir, "raw_records").where("record_id is not null").groupBy("record_id").agg(F.min(F.struct("asset_id", "source_id", "available_at")).alias("r"))
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"r.{c}"))
    state = F.when(F.col("r").isNull(), "no_record").when(differs("asset_id"), "other_asset").when(differs("source_id"), "other_source").when(differs("available_at"), "other_time").otherwise("traced")
    return o.join(r, "record_id", "left").groupBy("source_id", state.alias("state")).agg(F.count(F.lit(1)).alias("observations"))


def top_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten candles of each product by time, and whether there are more."""
    c = table(spark, sf_dir, "spot_candles").where("product_id is not null and candle_start is not null").select("product_id", "candle_start").distinct()
    line = Window.partitionBy("product_id").orderBy("candle_start")
    place = c.withColumn("place", F.row_number().over(line)).where("place <= 11").withColumn("truncated", F.max("place").over(Window.partitionBy("product_id")) > 10)
    return place.where("place <= 10")


def agg_lineage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records each asset's annual period rests on, each once and in order; a period has few filings."""
    o = table(spark, sf_dir, "observations").where("frequency = 'annual' and asset_id is not null and period_end is not null and raw_record_id is not null")
    one = o.select("asset_id", F.to_date("period_end").alias("period"), "raw_record_id").distinct()
    return one.groupBy("asset_id", "period").agg(F.array_join(F.array_sort(F.collect_set("raw_record_id")), ",").alias("records"))


def agg_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, different ids and the last availability of the stored tables."""
    out = None
    for name, key in (("spot_candles", "candle_id"), ("funding_history", "funding_id"), ("daily_bars", "bar_id"), ("observations", "observation_id"), ("raw_records", "record_id")):
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("ids"), F.max("available_at").alias("last_available")).select(F.lit(name).alias("name"), "n", "ids", "last_available")
        out = one if out is None else out.unionAll(one)
    return out


def bars_last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each product's bars of the 24 hours that end with its last one."""
    b = revised(spark, sf_dir).select("product_id", "at_us", "close")
    last = b.groupBy("product_id").agg(F.max("at_us").alias("last_us"))
    return b.join(last, "product_id").where(F.col("at_us") > F.col("last_us") - F.lit(86_400_000_000).cast("long")).select("product_id", "at_us", "close")


def diag_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How old each asset's last facts were at the cut, by their period and by their availability, in days."""
    o = table(spark, sf_dir, "observations").where(f"asset_id is not null and quality = 'valid' and available_at <= timestamp_ntz'{FACTS_KNOWN_AT}'")
    age = lambda c: F.datediff(F.lit(FACTS_KNOWN_AT[:10]).cast("date"), F.max(c).cast("date"))
    return o.groupBy("asset_id").agg(age("period_end").alias("period_age"), age("available_at").alias("availability_age"))


def der_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of each instrument's last funding sums by their sign, and how many of the three windows there are."""
    f = der_funding_windows(spark, sf_dir).groupBy("instrument_name", "hours").agg(F.max_by("total", "hour").alias("total"))
    sign = lambda n: F.max(F.when(F.col("hours") == n, F.when(F.col("total") > 0, "positive").when(F.col("total") < 0, "negative").otherwise("neutral")))
    n = F.count(F.lit(1))
    return f.groupBy("instrument_name").agg(*[sign(h).alias(f"funding_{h}h") for h in (24, 168, 720)], n.alias("windows"), F.when(n == 3, "complete").otherwise("partial").alias("status"))


QUERIES = {
    f.__name__: f
    for f in (
        scan_observations, scan_bulk_get, scan_empty_list, scan_day_bounds, agg_counts, top_last_periods, top_newest, top_whole_buckets, set_operations, join_resolve_alias, join_semi_anti,
        src_volatility_points, src_filing_index, src_company_facts, src_verified, sink_lineage, fn_scalars, fn_numbers, fn_identity, fn_isin, check_strict, plan_refresh,
        join_fact_filing, join_traceability, top_truncated, agg_lineage_ids, agg_overview, bars_last_day, diag_freshness, der_reading,
    )
}

_PAD = "case when length(ltrim(regexp_replace(cik, '\\D', '', 'g'), '0')) between 1 and 10 then lpad(ltrim(regexp_replace(cik, '\\D', '', 'g'), '0'), 10, '0') end"
SQL = {
    "join_fact_filing": """with o as (select distinct observation_id, json_extract_string(record_key, '$.accn') as accn, json_extract_string(record_key, '$.form') as form, asset_id, period_end::date as period, available_at::date as seen from observations where observation_id is not null),
        f as (select distinct accession_number as accn, asset_id, form, report_date, filing_date from sec_filings where accession_number is not null), n as (select accn, count(*) as n from f group by 1), g as (select f.*, n.n, row_number() over (partition by f.accn) as k from f join n on f.accn = n.accn)
        select case when g.accn is null then 'no_filing' when g.n > 1 then 'contradictory_filing' when not coalesce(o.asset_id = g.asset_id, false) then 'other_asset' when not coalesce(o.form = g.form, false) then 'other_form'
          when not coalesce(o.period = g.report_date, false) then 'other_period' when not coalesce(o.seen >= g.filing_date, false) then 'before_filing' else 'agrees' end as state, count(*) as facts from o left join (select * from g where k = 1) g on o.accn = g.accn group by 1""",
    "join_traceability": """with o as (select distinct observation_id, raw_record_id, asset_id, source_id, available_at from observations where observation_id is not null), r as (select distinct record_id, asset_id, source_id, available_at from raw_records where record_id is not null)
        select o.source_id, case when r.record_id is null then 'no_record' when o.asset_id is distinct from r.asset_id then 'other_asset' when o.source_id is distinct from r.source_id then 'other_source' when o.available_at is distinct from r.available_at then 'other_time' else 'traced' end as state,
          count(*) as observations from o left join r on o.raw_record_id = r.record_id group by 1, 2""",
    "top_truncated": """with c as (select distinct product_id, candle_start from spot_candles where product_id is not null and candle_start is not null), p as (select *, row_number() over (partition by product_id order by candle_start) as place, count(*) over (partition by product_id) as n from c)
        select product_id, candle_start, place, n > 10 as truncated from p where place <= 10""",
    "agg_lineage_ids": """select asset_id, period_end::date as period, string_agg(distinct raw_record_id, ',' order by raw_record_id) as records from observations where frequency = 'annual' and asset_id is not null and period_end is not null and raw_record_id is not null group by 1, 2""",
    "agg_overview": " union all ".join(f"select '{name}' as name, count(*) as n, count(distinct {key}) as ids, max(available_at) as last_available from {name}" for name, key in (("spot_candles", "candle_id"), ("funding_history", "funding_id"), ("daily_bars", "bar_id"), ("observations", "observation_id"), ("raw_records", "record_id"))),
    "bars_last_day": _BARS + "select product_id, at_us, close from (select *, max(at_us) over (partition by product_id) as last from bars) x where at_us > last - 86400000000",
    "diag_freshness": f"""select asset_id, datediff('day', max(period_end)::date, date '{FACTS_KNOWN_AT[:10]}') as period_age, datediff('day', max(available_at)::date, date '{FACTS_KNOWN_AT[:10]}') as availability_age
        from observations where asset_id is not null and quality = 'valid' and available_at <= timestamp '{FACTS_KNOWN_AT}' group by 1""",
    "der_reading": f"""with w as ({MARKET_SQL['der_funding_windows']}), l as (select instrument_name, hours, arg_max(total, hour) as total from w group by 1, 2), d as (select *, case when total > 0 then 'positive' when total < 0 then 'negative' else 'neutral' end as sign from l)
        select instrument_name, max(sign) filter (hours = 24) as funding_24h, max(sign) filter (hours = 168) as funding_168h, max(sign) filter (hours = 720) as funding_720h, count(*) as windows, case when count(*) = 3 then 'complete' else 'partial' end as status from d group by 1""",
    "scan_observations": """select distinct observation_id, asset_id, field_name, obs_value from observations where frequency = 'annual' and quality = 'valid' and unit = 'USD' and field_name in ('fundamental.revenue', 'fundamental.net_income')
        and period_end between timestamp '2016-01-01' and timestamp '2020-12-31 23:59:59' and available_at between timestamp '2016-01-01' and timestamp '2024-01-01' and accepted_at >= timestamp '2016-01-01' and normalized_at < timestamp '2025-01-01'
        and asset_id is not null and observation_id is not null and json_extract_string(record_key, '$.form') = '10-K' and source_id like 'sec-%'""",
    "scan_bulk_get": """select a.record_id, r.source_id, r.received_at, r.record_id is not null as found from (select distinct raw_record_id as record_id from observations where raw_record_id is not null) a
        left join (select distinct record_id, source_id, received_at from raw_records) r on r.record_id = a.record_id""",
    "scan_empty_list": "select observation_id from observations where 1 = 0",
    "scan_day_bounds": "select event_type, count(*) as n, round(sum(value), 4) as total from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-08' group by 1",
    "agg_counts": "select field_name, frequency, count(*) as n, count(distinct observation_id) as ids, min(available_at) as first_available, max(available_at) as last_available from observations group by 1, 2",
    "top_last_periods": """select * from (select asset_id, period, row_number() over (partition by asset_id order by period desc) as place from (select distinct asset_id, period_end::date as period from observations
        where frequency = 'annual' and asset_id is not null and period_end is not null) p) x where place <= 3""",
    "top_newest": "select distinct summary_id, instrument_name, creation_timestamp from perpetual_summaries where creation_timestamp is not null order by creation_timestamp desc, summary_id limit 50",
    "top_whole_buckets": _BARS + """, d as (select distinct product_id, make_timestamp(at_us)::date as day from bars), w as (select product_id, date_trunc('week', day)::date as week, count(*) as members from d group by 1, 2)
        select product_id, week, members, used from (select *, sum(members) over (partition by product_id order by week desc rows unbounded preceding)::bigint as used, row_number() over (partition by product_id order by week desc) as place from w) x
        where used <= 20 or place = 1""",
    "set_operations": """with a as (select distinct asset_id from valuation_requests where asset_id is not null), k as (select distinct asset_id from observations where asset_id is not null)
        select 'union' as name, asset_id from (select * from a union select * from k) u union all select 'both', asset_id from (select * from a intersect select * from k) i
        union all select 'asked_only', asset_id from (select * from a except select * from k) e union all select 'known_only', asset_id from (select * from k except select * from a) f""",
    "join_resolve_alias": f"""select key, count(distinct asset_id) as assets, min(asset_id) as asset_id, count(*) as filings, count(distinct asset_id) > 1 as ambiguous
        from (select {_PAD} as key, asset_id from sec_filings) f where key is not null and asset_id is not null group by 1""",
    "join_semi_anti": "select distinct c.product_id, exists (select 1 from import_summaries r where r.product_id = c.product_id) as imported from spot_candles c where product_id is not null",
    "src_verified": "select source_id, count(*) as records, sum((sha256(payload) = lower(checksum_sha256))::int)::bigint as verified from raw_records where payload is not null group by 1",
    "sink_lineage": """select 'lineitem' as child, count(distinct l_orderkey) as broken from lineitem where l_orderkey not in (select o_orderkey from orders)
        union all select 'orders', count(*) from orders where o_custkey not in (select c_custkey from customer)""",
    "fn_scalars": f"""select distinct filing_id, {_PAD} as padded, sha256(accession_number) as checksum, trim(regexp_replace(lower('nandu ' || coalesce(form, '')), '[^a-z0-9]+', ' ', 'g')) as name_key,
        least(greatest(filing_id / 100.0, 1.0), 5.0)::double as clamped from sec_filings""",
    "fn_numbers": "select distinct vintage_row_id, case when trim(raw_value) not in ('.', '', 'NA') then round(try_cast(replace(trim(raw_value), ',', '') as double), 4) end as number from macro_vintages",
    "fn_identity": f"""with d as (select distinct filing_id, '{{"accession":' || coalesce(to_json(accession_number)::varchar, 'null') || ',"form":' || coalesce(to_json(form)::varchar, 'null') || '}}' as text from sec_filings),
        h as (select *, sha1(unhex('{NAMESPACE.replace('-', '')}') || encode(text)) as x from d)
        select filing_id, text, x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab', 1 + (('0x' || x[17:17])::int % 4), 1) || x[18:20] || '-' || x[21:32] as identity from h""",
    "fn_isin": "select p_partkey, 1 as fits from part",
    "check_strict": _BARS + "select product_id, count(*) as bars from bars group by 1",
    "plan_refresh": _BARS + """select r.product_id, begins, ends, coalesce(l, begins) as fetch_from, case when l is null then 'initial' when l >= ends then 'current' else 'incremental' end as mode
        from (select product_id, min(epoch_us(requested_start)) as begins, max(epoch_us(requested_end)) as ends from import_summaries group by 1) r left join (select product_id, max(at_us) as l from bars group by 1) b on r.product_id = b.product_id""",
    "src_volatility_points": OPENED.format(source="deribit-dvol", part="result") + """ d as (select record_id, case when json_type(x, '$.data') = 'VARCHAR' then json_extract_string(x, '$.data')::json else json_extract(x, '$.data') end as a from own),
        n as (select record_id, a, unnest(range(json_array_length(a)::bigint)) as position from d where json_type(a) = 'ARRAY')
        select record_id, position, try_cast(json_extract_string(a, '$[' || position || '][0]') as bigint) as epoch_ms, try_cast(json_extract_string(a, '$[' || position || '][1]') as double) as open, try_cast(json_extract_string(a, '$[' || position || '][4]') as double) as close
        from n where json_type(json_extract(a, '$[' || position || ']')) = 'ARRAY'""",
    "src_company_facts": FACTS + """ select record_id, tax as taxonomy, tag, unit, position, try_cast(json_extract_string(fact, '$.val') as double) as val, json_extract_string(fact, '$.accn') as accn from facts""",
    "src_filing_index": OPENED.format(source="sec-submissions", part="body") + """ d as (select record_id, json_extract(x, '$.filings.recent') as f from own),
        n as (select record_id, f, unnest(range(json_array_length(json_extract(f, '$.accessionNumber'))::bigint)) as position from d where json_type(json_extract(f, '$.accessionNumber')) = 'ARRAY')
        select record_id, position, json_extract_string(f, '$.accessionNumber[' || position || ']') as accession, nullif(json_extract_string(f, '$.filingDate[' || position || ']'), '') as filed, nullif(json_extract_string(f, '$.form[' || position || ']'), '') as form
        from n where json_extract_string(f, '$.accessionNumber[' || position || ']') is not null""",
}
