"""Nested records against cases by hand."""

import json

from pitspark.operators.dedupe import one_per_key
from pitspark.operators.shred import read_payload, shred, table_of, visit, write_tables

FACT = {"end": "2020-12-31", "val": 5, "accn": "a-1", "segments": [{"axis": "R", "member": "m"}, None, {"axis": "P", "member": "n"}]}
FACTS = {"body": {"cik": 1, "facts": {"dei": {"Cash": {"units": {"USD": [FACT, None, {"end": "x", "val": "odd"}], "EUR": {"val": 1.5}}}, "None": {"units": None}, "Text": "t"}, "srt": None}}}
FILINGS = {"body": {"filings": {"recent": {"accessionNumber": ["x", None, "z"], "form": ["10-K"]}, "files": [None, {"name": "f.json"}, {"filingCount": 3}]}}}
POINTS = {"result": {"data": [[1599177600000, 1.0, 2.0, 0.5, None], None, [1599264000000, 3]]}}


def cases(payload):
    return [n[3:8] for n in visit("r", read_payload(payload))]


def test_visitor():
    assert cases(json.dumps(FACTS)) == [
        ("dei", "Cash", "USD", 0, -1), ("dei", "Cash", "USD", 0, 0), ("dei", "Cash", "USD", 0, 2), ("dei", "Cash", "USD", 2, -1), ("dei", "Cash", "EUR", 0, -1),
    ]
    assert cases(json.dumps(FILINGS)) == [("filings", "recent", "x", 0, -1), ("filings", "recent", "z", 2, -1), ("filings", "files", "f.json", 1, -1), ("filings", "files", None, 2, -1)]
    assert cases(json.dumps(POINTS)) == [("result", "data", "1599177600000", 0, -1), ("result", "data", "1599264000000", 2, -1)]


def test_odd_payloads():
    assert len(cases("﻿  " + json.dumps(POINTS))) == 2  # byte order mark
    assert len(cases(json.dumps(json.dumps(POINTS)))) == 2  # JSON within JSON
    assert len(cases(json.dumps({"body": json.dumps(FACTS["body"])}))) == 5
    for bad in (None, "", "null", "5", "[1]", "{", '{"body":', json.dumps({"result": None}), json.dumps({"body": {"facts": [1], "filings": {"recent": None, "files": {}}}}), "[" * 100_000):
        assert [c for c in cases(bad) if c[1] != "files"] == []


def test_tables(spark, tmp_path):
    rows = [("a", json.dumps(FACTS), 1), ("a", json.dumps(FACTS), 1), ("b", json.dumps(POINTS), 2), ("c", "{", 3), ("d", None, 4), (None, json.dumps(POINTS), 5)]
    nodes = shred(spark.createDataFrame(rows, "record_id string, payload string, level1 int"))
    assert nodes.count() == 7
    facts, segments = table_of(nodes, "fact"), table_of(nodes, "segment")
    assert {(r.level3, r.item_no, r.val) for r in facts.collect()} == {("USD", 0, 5.0), ("USD", 2, None), ("EUR", 0, 1.5)}
    assert segments.join(facts.select("node_key").withColumnRenamed("node_key", "parent_key"), "parent_key").count() == 2
    write_tables(nodes, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t" / "tag=point")).count() == 2
    assert shred(spark.createDataFrame([], "record_id string, payload string")).count() == 0


def test_one_per_key(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (None, "c")], "k int, x string")
    assert sorted((r.k or 0, r.x) for r in one_per_key(df, "k").collect()) == [(0, "c"), (1, "a"), (2, "b")]
    assert one_per_key(df.limit(0), "k").count() == 0
