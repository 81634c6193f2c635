"""Landed documents, transport, HTML tables, stores and scalar functions."""

import hashlib
import io
import json
import urllib.error
import uuid

import pytest
from pyspark.sql import functions as F

from pitspark.functions.scalars import canonical_json, clamp, isin_is_valid, name_key, number_or_null, pad_cik, uuid5
from pitspark.sources import landed, stores
from pitspark.sources.html_tables import html_rows, tables_of
from pitspark.sources.simulated import SimulatedBars
from pitspark.sources.transport import chunks, fetch, pages


def test_landed(spark):
    docs = {
        "candles": [[1, "1.5", 2, 1.7, 1.9, 10], None, [2, 1, 2, 1, None, "x"]],
        "bars": {"bars": [{"t": "2025-01-01", "o": 1, "v": 2}, {"t": None}]},
        "funding": {"result": [{"timestamp": 5, "interest_1h": 0.1}]},
        "snapshots": {"observations": [{"series_id": "s", "observation_date": "2020-01-01", "realtime_start": "2020-02-01", "value": "."}]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [("bad", "{"), ("null", None)], "id string, payload string")
    own = lambda name: df.where(F.col("id").isin(name, "bad", "null"))
    assert [(r.position, r.low, r.close, r.volume) for r in landed.candles(own("candles")).collect()] == [(0, 1.5, 1.9, 10.0), (2, 1.0, None, None)]
    assert [(r.t, r.o, r.n) for r in landed.bars(own("bars")).collect()] == [("2025-01-01", 1.0, None), (None, None, None)]
    assert landed.funding(own("funding")).first().interest_1h == 0.1
    assert str(landed.snapshots(own("snapshots")).first().realtime_start) == "2020-02-01"
    good = spark.createDataFrame([("x", hashlib.sha256(b"x").hexdigest()), ("y", "0" * 64), (None, "0")], "payload string, checksum_sha256 string")
    assert [r.verified for r in landed.verified(good).collect()] == [True, False, False]


def test_transport():
    calls, naps = [], []

    class Reply(io.BytesIO):
        status, headers = 200, {"Content-Type": "text/plain"}

    def opener(request, timeout):
        calls.append(request)
        if len(calls) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {"Retry-After": "9"}, None)
        return Reply(b"0123456789")

    got = fetch("https://x.example/", form={"a": "b"}, most_bytes=4, opener=opener, sleep=naps.append)
    assert (got.body, got.truncated, got.status, naps) == (b"0123", True, 200, [5.0, 5.0]) and calls[0].data == b"a=b"
    with pytest.raises(ValueError):
        fetch("http://x.example/")
    assert chunks(0, 10, 1, 4) == [(0, 4), (4, 8), (8, 10)]
    assert pages(lambda t: ([1], "n") if t is None else ([2], None)) == [1, 2]
    with pytest.raises(ValueError):
        pages(lambda t: ([1], "same"))


def test_html(spark):
    html = "<table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><td>x</td><td> y&amp; z </td></tr></table><table><tr><td>open"
    assert tables_of(html) == [[["A", "B", "B"], ["A", "x", "y& z"]], [["open"]]]
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "id long, html string")
    assert [(r.table_no, r.row_no, r.cells) for r in html_rows(df, "id", "html").collect()] == [(0, 0, ["A", "B", "B"]), (0, 1, ["A", "x", "y& z"]), (1, 0, ["open"])]


def test_simulated(spark):
    spark.dataSource.register(SimulatedBars)
    df = spark.read.format("simulated_bars").option("assets", 3).option("bars", 4).load()
    assert df.count() == 12 and df.where("low > open or high < open").count() == 0


def test_stores(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, x string")
    assert stores.append_only(rows, path, "id") == 2
    assert stores.append_only(spark.createDataFrame([(2, "b"), (3, None)], "id int, x string"), path, "id") == 1
    for bad in ([(1, "z")], [(9, "a"), (9, "b")]):
        with pytest.raises(stores.RecordConflict):
            stores.append_only(spark.createDataFrame(bad, "id int, x string"), path, "id")
    assert spark.read.parquet(path).count() == 3
    new = stores.upserted(rows.distinct(), spark.createDataFrame([(2, "c"), (4, "d")], "id int, x string"), "id")
    assert sorted((r.id, r.x) for r in new.collect()) == [(1, "a"), (2, "c"), (4, "d")]
    out = str(tmp_path / "o")
    stores.export(rows, out, ["id"])
    with pytest.raises(Exception, match="(?i)already exists"):
        stores.export(rows, out, ["id"])
    stores.export_text(rows, str(tmp_path / "c"), "csv")
    stores.export_text(rows, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    child = spark.createDataFrame([("m", [1, 7]), ("n", [2])], "id string, inputs array<int>")
    assert [(r.id, r.missing) for r in stores.broken_lineage(child, "inputs", rows, "id", "id").collect()] == [("m", 7)]


def test_scalars(spark):
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    names = ["", "a", "http://x.example/ñ", "z" * 500]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(uuid5(space, F.col("n"))).collect()] == [str(uuid.uuid5(uuid.UUID(space), n)) for n in names]
    isins = {"US0378331005": True, "US0378331004": False, "AU0000XVGZA3": True, "us0378331005": False, "US03783310": False, None: False}
    df = spark.createDataFrame([(k,) for k in isins], "c string")
    assert {r.c: r.v for r in df.select("c", isin_is_valid(F.col("c")).alias("v")).collect()} == isins
    one = spark.createDataFrame([(" Ñandú & Co.", "CIK 0000123", ".", 7.0)], "n string, k string, v string, x double")
    got = one.select(name_key(F.col("n")), pad_cik(F.col("k")), number_or_null(F.col("v")), clamp(F.col("x"), 0, 5), canonical_json(b=F.col("v"), a=F.lit(None).cast("string"))).first()
    assert tuple(got) == ("nandu co", "0000000123", None, 5.0, '{"a":null,"b":"."}')


def test_spans_right_of_short_rows_and_tables_in_cells():
    from pitspark.sources.html_tables import tables_of

    grid = tables_of("<table><tr><td>a</td><td>b</td><td rowspan=3>c</td></tr><tr><td>d</td></tr><tr><td>e</td><td>f</td></tr><tr><td>g</td></tr></table>")
    assert grid == [[["a", "b", "c"], ["d", "", "c"], ["e", "f", "c"], ["g"]]]
    nested = tables_of("<table><tr><td>before <table><tr><td>in</td></tr></table> after</td><td>x</td></tr></table>")
    assert nested == [[["in"]], [["before after", "x"]]]


def test_typed_quotes(spark):
    from pitspark.sources.html_tables import html_rows, typed_quotes

    page = "<table><tr><th>Name</th><th>Price</th><th>Volume</th></tr><tr><td>AAA</td><td>1,234.50</td><td>10</td></tr><tr><td>BBB</td><td>-</td><td>7</td></tr></table>"
    rows = html_rows(spark.createDataFrame([("d1", page), ("d2", None)], "day string, html string"), "day", "html")
    names = {"name": (0, "string"), "price": (1, "double"), "volume": (2, "long")}
    assert sorted(map(tuple, typed_quotes(rows, "day", names).collect())) == [("d1", "AAA", 1234.5, 10), ("d1", "BBB", None, 7)]
    twice = html_rows(spark.createDataFrame([("d1", page), ("d1", page.replace("1,234.50", "2"))], "day string, html string"), "day", "html")
    with pytest.raises(Exception, match="comes twice"):
        typed_quotes(twice, "day", names).collect()


def test_unreadable_tables_are_errors_and_restores(spark, tmp_path):
    from pitspark.sources.stores import append_only, lineage_chain, restore

    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/part.parquet").write_bytes(b"nothing")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2)], "k string, v int")
    with pytest.raises(Exception):
        append_only(rows, str(tmp_path / "bad"), "k")
    assert append_only(rows, str(tmp_path / "t"), "k") == 2 and append_only(rows, str(tmp_path / "t"), "k") == 0
    rows.distinct().write.parquet(str(tmp_path / "backup"))
    spark.createDataFrame([("c", 3)], "k string, v int").write.mode("append").parquet(str(tmp_path / "backup"))
    assert restore(spark, str(tmp_path / "backup"), str(tmp_path / "t"), "k") == 1
    raw, obs, metric = (spark.createDataFrame(x, "k string, i string") for x in ([("r1", None)], [("o1", "r1"), ("o2", "r9")], [("m1", "o1"), ("m2", "o7")]))
    assert sorted(map(tuple, lineage_chain([(raw, "k", "i"), (obs, "k", "i"), (metric, "k", "i")]).collect())) == [(1, "o2", "r9"), (2, "m2", "o7")]
