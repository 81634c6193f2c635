"""Regular grids against brute force."""

import random

from pitspark.operators.regular_grid import counter_increments, distribute, grid, regular_series


def frames(spark, windows, readings):
    return spark.createDataFrame(windows, "series string, step long, first long, last long"), spark.createDataFrame(readings, "series string, step long, cell long")


def test_uncovered_against_brute_force(spark):
    rng = random.Random(5)
    windows = [(s, 60, a := rng.randrange(-200, 400), a + rng.randrange(-3, 200)) for s in "abc" for _ in range(6)] + [(None, 60, 0, 5), ("a", None, 0, 5)]
    readings = [(rng.choice("abc"), 60, rng.randrange(-300, 700)) for _ in range(700)] * 2 + [(None, 60, 1), ("a", 60, None)]
    w, r = frames(spark, windows, readings)
    wanted = {(s, c) for s, step, a, b in windows if s and step for c in range(a, b + 1)}
    there = {(s, c) for s, _, c in readings}
    assert sorted((x.series, x.cell) for x in grid(w, r).where("not covered").collect()) == sorted(wanted - there)
    got = {(x.series, x.cell): x.covered for x in grid(w, r).collect()}
    assert got == {k: k in there for k in wanted}


def test_empty(spark):
    w, r = frames(spark, [], [])
    assert grid(w, r).where("not covered").count() == 0
    w, _ = frames(spark, [("a", 1, 0, 130)], [])
    assert grid(w, r).where("not covered").count() == 131


def test_counters_over_blocks_and_resets(spark):
    readings = [("a", 0, 10.0), ("a", 5, 15.0), ("a", 5, 15.0), ("a", 95, 20.0), ("a", 130, 4.0), ("a", 400, 9.0), ("b", 7, 1.0), (None, 1, 1.0), ("a", None, 2.0), ("a", 6, None)]
    df = spark.createDataFrame(readings, "series string, at long, value double")
    for block in (10, 1000):
        got = sorted((r.series, r.at, r.until, r.amount, r.reset) for r in counter_increments(df, block).collect())
        assert got == [("a", 0, 5, 5.0, False), ("a", 5, 95, 5.0, False), ("a", 95, 130, 4.0, True), ("a", 130, 400, 5.0, False)]


def test_shares_add_up(spark):
    rng = random.Random(6)
    rows = [("a", 10, a := rng.randrange(0, 500), a + rng.randrange(1, 90), rng.random()) for _ in range(80)] + [("a", 10, 5, 5, 1.0), ("a", 10, 5, 9, None)]
    shared = distribute(spark.createDataFrame(rows, "series string, step long, at long, until long, amount double")).collect()
    assert abs(sum(r.amount for r in shared) - sum(x[4] for x in rows[:80])) < 1e-9
    one = distribute(spark.createDataFrame([("a", 10, 5, 25, 4.0)], "series string, step long, at long, until long, amount double"))
    assert {r.cell: r.amount for r in one.collect()} == {0: 1.0, 1: 2.0, 2: 1.0}


def test_series_marks_what_nothing_reaches(spark):
    w, r = frames(spark, [("a", 10, 0, 3)], [("a", 10, 0)])
    inc = spark.createDataFrame([("a", 10, 5, 15, 2.0)], "series string, step long, at long, until long, amount double")
    assert {x.cell: (x.covered, x.amount) for x in regular_series(w, r, inc).collect()} == {0: (True, 1.0), 1: (False, 1.0), 2: (False, None), 3: (False, None)}
