"""Deeply nested records as flat related tables, by one depth-first pass that tags what it emits.

A visitor walks each payload once and yields nodes: the table they belong to, a primary key, the parent's key, their
place and their own fields as JSON. Writing the nodes partitioned by tag and applying a tag's schema gives the tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.operators.dedupe import one_per_key
from pitspark.session import ROW

NODE_SCHEMA = (
    "record_id string, tag string, node_key string, parent_key string, level1 string, level2 string, level3 string, "
    "item_no int, sub_no int, payload string"
)
#: Schemas of the tables, by tag; optional fields are null where a record leaves them out.
TABLES = {
    "fact": "`end` string, `start` string, val double, accn string, form string, filed string, fy int, fp string, frame string",
    "segment": "axis string, member string",
    "filing": "accessionNumber string, filingDate string, reportDate string, form string, acceptanceDateTime string",
    "file": "name string, filingCount long, filingFrom string, filingTo string",
    "point": "epoch_ms long, `open` double, high double, low double, `close` double",
}
#: A text that holds JSON is opened at most so often.
_REOPEN = 3


def _value(x: object) -> object:
    """A value that was delivered as JSON text, opened; anything else as it is."""
    for _ in range(_REOPEN):
        if not isinstance(x, str) or x.lstrip("﻿ \t\r\n")[:1] not in ("{", "["):
            break
        try:
            x = json.loads(x.lstrip("﻿ \t\r\n"))
        except (ValueError, RecursionError):
            break
    return x


def read_payload(text: str | None) -> object:
    """The payload's value, or None where it can't be read. A byte order mark and JSON within JSON are accepted."""
    if not isinstance(text, str):
        return None
    try:
        return _value(json.loads(text.lstrip("﻿ \t\r\n")))
    except (ValueError, RecursionError):
        return None


def _dict(x: object) -> dict:
    x = _value(x)
    return x if isinstance(x, dict) else {}


def _items(x: object) -> list:
    """A list, or the one element that stands in place of a list."""
    x = _value(x)
    return x if isinstance(x, list) else [] if x is None else [x]


def _key(*parts: object) -> str:
    return json.dumps([str(p) for p in parts], ensure_ascii=False, separators=(",", ":"))


Node = tuple[str, str, str, str | None, str | None, str | None, int, int, dict]


def _facts(record_id: str, body: dict) -> Iterator[Node]:
    for taxonomy, tags in _dict(body.get("facts")).items():
        for tag, concept in _dict(tags).items():
            for unit, facts in _dict(_dict(concept).get("units")).items():
                for n, fact in enumerate(_items(facts)):
                    if not isinstance(fact, dict):
                        continue
                    key = _key(record_id, taxonomy, tag, unit, n)
                    yield "fact", key, record_id, taxonomy, tag, unit, n, -1, {k: v for k, v in fact.items() if k != "segments"}
                    for m, segment in enumerate(_items(fact.get("segments"))):
                        if segment is not None:
                            own = segment if isinstance(segment, dict) else {"member": segment}
                            yield "segment", _key(record_id, taxonomy, tag, unit, n, m), key, taxonomy, tag, unit, n, m, own


def _filings(record_id: str, body: dict) -> Iterator[Node]:
    filings = _dict(body.get("filings"))
    recent = _value(filings.get("recent"))
    if isinstance(recent, dict):
        columns = {k: v for k, v in ((k, _value(v)) for k, v in recent.items()) if isinstance(v, list)}
        rows = [{k: v[n] for k, v in columns.items() if n < len(v)} for n in range(len(columns.get("accessionNumber", [])))]
    else:
        rows = _items(recent)
    for n, row in enumerate(rows):
        if isinstance(row, dict) and row.get("accessionNumber") is not None:
            yield "filing", _key(record_id, "recent", n), record_id, "filings", "recent", str(row["accessionNumber"]), n, -1, row
    for n, file in enumerate(_items(filings.get("files"))):
        if isinstance(file, dict):
            name = file.get("name")
            yield "file", _key(record_id, "files", n), record_id, "filings", "files", None if name is None else str(name), n, -1, file


def _points(record_id: str, result: dict) -> Iterator[Node]:
    for n, row in enumerate(_items(result.get("data"))):
        if isinstance(row, list) and row:
            ms = row[0]
            at = None if ms is None else str(int(ms)) if isinstance(ms, float) and ms == ms and abs(ms) < 1e18 else str(ms)
            own = dict(zip(("epoch_ms", "open", "high", "low", "close"), row, strict=False))
            yield "point", _key(record_id, "data", n), record_id, "result", "data", at, n, -1, own


def visit(record_id: str, payload: object) -> Iterator[Node]:
    """The innermost objects of one payload, depth first; nothing for a payload of no known form."""
    top = _dict(payload)
    body = _dict(top.get("body"))
    yield from _facts(record_id, body)
    yield from _filings(record_id, body)
    yield from _points(record_id, _dict(top.get("result")))


def shred(records: DataFrame, visitor: Callable[[str, object], Iterator[Node]] = visit) -> DataFrame:
    """The nodes of all records (record_id, payload), see NODE_SCHEMA.

    A record delivered twice counts once (see ``one_per_key``). Null, empty and unreadable payloads and null ids give no node; null elements
    give none but keep their position. Other columns of the input are not read. A payload is held in memory one at a
    time, nodes in batches.
    """

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in NODE_SCHEMA.split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for record_id, text in zip(batch["record_id"], batch["payload"], strict=True):
                if record_id is None:
                    continue
                for node in visitor(record_id, read_payload(text)):
                    rows.append((record_id, *node[:-1], json.dumps(node[-1], ensure_ascii=False)))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    own = records.select("record_id", "payload", *[c for c in records.columns if c == ROW])
    return one_per_key(own, "record_id").select("record_id", "payload").mapInPandas(emit, NODE_SCHEMA)


def table_of(nodes: DataFrame, tag: str) -> DataFrame:
    """One of the flat tables: keys, place and the typed fields of its schema. A field of another type is null."""
    own = F.from_json("payload", TABLES[tag], {"mode": "PERMISSIVE"})
    place = ["record_id", "node_key", "parent_key", "level1", "level2", "level3", "item_no", "sub_no"]
    return nodes.where(F.col("tag") == tag).select(*place, own.alias("own")).select(*place, "own.*")


def write_tables(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """All nodes in one pass, as one folder for each tag."""
    nodes.write.mode(mode).partitionBy("tag").parquet(path)
