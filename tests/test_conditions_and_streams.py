"""Conditions, their fold, and the same fold as a stream."""

import random

from pyspark.sql import functions as F

from pitspark.operators.conditions import all_met, fold, new_state, outcome, relaxes, step
from pitspark.streaming.lifecycle import lifecycle, once, windowed_bars

SCHEMA = "stream string, at long, entry string, hold string"


def evaluations(n=400):
    rng = random.Random(2)
    pick = lambda: rng.choice(["met", "met", "not_met", "not_evaluable", None])
    return [(rng.choice("abc"), k * 10, pick(), pick()) for k in range(n)]


def plain(rows, confirmations, cooldown):
    states, out = {}, []
    for s, at, entry, hold in sorted(rows, key=lambda r: (r[0], r[1])):
        if event := step(states.setdefault(s, new_state()), at, entry, hold, confirmations, cooldown):
            out.append((s, at, event))
    return sorted(out)


def test_outcomes(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (0.0, None)], "a double, b double")
    a, b = outcome(F.col("a"), "gte", 1.0), outcome(F.col("b"), "lt", 5.0)
    assert [tuple(r) for r in df.select(a, b, all_met([a, b])).collect()] == [("met", "met", "met"), ("met", "not_evaluable", "not_evaluable"), ("not_met", "not_evaluable", "not_met")]
    assert relaxes("gte", 1.5, 1.2) and not relaxes("gt", 1.0, 1.2) and relaxes("lte", 30, 35) and not relaxes("eq", 1, 1)


def test_fold(spark):
    rows = evaluations()
    df = spark.createDataFrame(rows + rows[:20] + [(None, 1, "met", "met"), ("a", None, "met", "met")], SCHEMA)
    for batch in (9, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        assert sorted(tuple(r) for r in fold(df, 2, 300).collect()) == plain(rows, 2, 300)
    assert fold(df.limit(0), 1, 0).count() == 0


def test_stream_equals_fold(spark, tmp_path):
    rows = evaluations(120)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = lifecycle(stream, 2, 300).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == plain(rows, 2, 300)


def test_windowed_stream_and_single_append(spark, tmp_path):
    ticks = [("a", f"2025-01-01 00:0{m}:0{s}", float(m * 10 + s), 1.0) for m in range(4) for s in range(3)]
    source = str(tmp_path / "ticks")
    df = spark.createDataFrame(ticks, "k string, t string, price double, volume double").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    q = windowed_bars(stream, "t", ["k"], "1 minute", "0 seconds").writeStream.format("memory").queryName("bars").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.begins.minute: (r.open, r.high, r.close, r.ticks) for r in spark.table("bars").collect()}
    assert got[0] == (0.0, 2.0, 2.0, 3) and len(got) >= 3
    out = str(tmp_path / "once")
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(source)
        once(stream, "price", out, str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(out).count() == 12
