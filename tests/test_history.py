"""Version histories against a plain fold, whatever the size of the batches."""

import random

from pitspark.operators.history import OPEN_END, numeric_value, version_history

SCHEMA = "entity string, item int, start int, value double, seen long, until int, extra string"


def brute(rows):
    keys = {}
    for e, i, s, v, seen, until, _ in rows:
        if None not in (e, i, s):
            keys.setdefault((e, i), []).append((s, v, -(2**62) if seen is None else seen, OPEN_END if until is None else until))
    out = set()
    for key, own in keys.items():
        versions = []
        for s in sorted({r[0] for r in own}):
            same = [r for r in own if r[0] == s]
            counts = max(same, key=lambda r: (r[2], float("-inf") if r[1] is None else r[1]))[1]
            kept = [r for r in same if r[1] == counts]
            if versions and versions[-1][1] == counts:
                versions[-1][2].extend(kept)
            else:
                versions.append([s, counts, list(kept)])
        for n, (s, v, kept) in enumerate(versions):
            last = max(kept, key=lambda r: (r[2], r[0]))
            end = max(r[3] for r in kept if (r[2], r[0]) == (last[2], last[0]))
            out.add((*key, v, s, min(end, versions[n + 1][0] - 1) if n + 1 < len(versions) else end))
    return out


def test_against_fold(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), rng.randrange(4), rng.randrange(40), rng.choice([1.0, 2.0, None]), rng.randrange(10**6), rng.choice([None, rng.randrange(60)]), "x") for _ in range(900)]
    rows += rows[:50] + [(None, 1, 1, 1.0, 1, 1, "x"), ("a", None, 1, 1.0, 1, 1, "x"), ("a", 1, None, 1.0, 1, 1, "x"), ("c", 1, 5, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    for batch in (7, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = [(r.entity, r.item, r.value, r.valid_from, r.valid_to) for r in version_history(df).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert version_history(df.limit(0)).count() == 0


def test_numbers(spark):
    texts = {"13,358.900": 13358.9, " 11712.966": 11712.966, "1.335890000e+04": 13358.9, "+13701.1000": 13701.1, ".": None, "NA": None, "": None, None: None, "nan": None, "1d": None, ".5": 0.5}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.v for r in df.select("t", numeric_value(df["t"]).alias("v")).collect()} == texts
