"""Spikes, stuck runs and limits in made-up series whose cases are known."""

import random

import numpy as np
from pyspark.sql import functions as F

from pitspark.operators.implausible import CHARTS, implausible

SCHEMA = "id long, source string, day int, dated boolean, seen long, h double, l double, c double, v double, note string"
GROUPS = {"price": ["h", "l", "c"], "volume": ["v"]}


def impossible():
    return (F.least("h", "l", "c") <= 0) | (F.col("v") < 0) | (F.col("l") > F.col("h")) | (F.col("c") < F.col("l")) | (F.col("c") > F.col("h"))


def series(name, n, step, seed, start=100.0):
    rng = random.Random(seed)
    out, p = [], start
    for k in range(n):
        p *= float(np.exp(rng.gauss(0, step)))
        out.append([0, name, k, True, k, p * (1 + abs(rng.gauss(0, step)) / 2), p * (1 - abs(rng.gauss(0, step)) / 2), p, float(round(1e6 * np.exp(rng.gauss(0, 0.4)))), "n"])
    return out


def test_known_cases(spark):
    calm, lively = series("calm", 300, 0.004, 1), series("lively", 300, 0.04, 2)
    calm[100][5] *= 1.2  # a spike of the high
    calm[150][7], calm[150][6] = calm[150][7] * 0.8, calm[150][7] * 0.79  # of the close and the low
    calm[200][8] *= 60  # of the volume
    for row in calm[240:]:  # a lasting change of level
        row[5], row[6], row[7] = row[5] * 1.6, row[6] * 1.6, row[7] * 1.6
    for row in lively[50:56]:  # stuck
        row[5], row[6], row[7] = lively[50][5], lively[50][6], lively[50][7]
    for row in lively[120:124]:  # too short a run
        row[8] = 900_000.0
    lively[180][6] = -1.0
    rows = calm + lively
    for k, row in enumerate(rows):
        row[0] = k
    expected = {100: "spike", 150: "spike", 200: "spike", **{300 + k: "stuck" for k in range(50, 56)}, 480: "impossible"}
    again = [[1000, *rows[100][1:]], [1001, *rows[350][1:]], [1002, *rows[0][1:]]]  # redelivered under other ids
    expected |= {1000: "spike", 1001: "stuck"}
    odd = [[2000, None, 5, True, 1, 1.0, -1.0, 1.0, 1.0, None], [2001, "calm", None, False, 1, 1.0, 1.0, 1.0, 1.0, None], [2002, "nulls", 1, True, 1, None, None, None, None, None]]
    expected |= {2000: "impossible"}
    df = spark.createDataFrame([tuple(r) for r in rows + again + odd], SCHEMA)
    got = implausible(df, impossible(), CHARTS, GROUPS)
    assert "note" in got.columns and got.count() == len(rows) + 6
    found = {r.id: "impossible" if r.impossible else "spike" if r.spike else "stuck" for r in got.collect() if r.impossible or r.spike or r.stuck}
    assert found == expected


def test_few_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert implausible(df, impossible(), CHARTS, GROUPS).count() == 0
    one = spark.createDataFrame([(1, "a", 1, True, 1, 2.0, 1.0, 1.5, 3.0, "x")], SCHEMA)
    assert [(r.spike, r.stuck, r.impossible) for r in implausible(one, impossible(), CHARTS, GROUPS).collect()] == [(False, False, False)]
