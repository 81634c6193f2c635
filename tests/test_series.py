"""Row frames, recursions, as-of joins and revisions against plain loops."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from pitspark.operators import indicators as ind
from pitspark.operators.bars import is_valid_bar, merged_intervals, pivot_fields, resample, unpivot_fields
from pitspark.operators.ordered import decayed_sum, index_rows
from pitspark.operators.pit import best_known, latest_revision, quality_name, quality_rank, require


def close_series(n, seed=4):
    rng = random.Random(seed)
    return [100 + 10 * rng.random() for _ in range(n)]


@pytest.fixture(scope="module")
def bars(spark):
    rows = [(name, t * 60, c, c + 1, c - 1, c, float(10 + t % 7)) for name, n in (("a", 1300), ("b", 30)) for t, c in enumerate(close_series(n))]
    return index_rows(spark.createDataFrame(rows, "s string, at long, open double, high double, low double, close double, volume double"), ["s"], "at", 3600)


def test_index(bars):
    got = sorted((r.s, r.rn, r.at) for r in bars.collect())
    assert got == [(s, k, k * 60) for s, n in (("a", 1300), ("b", 30)) for k in range(n)]


@pytest.mark.parametrize("n", [3, 40])
def test_sma_and_ema(bars, n):
    for s, length in (("a", 1300), ("b", 30)):
        c = close_series(length)
        sma = {r.rn: r.sma for r in ind.sma(bars, ["s"], n).where(F.col("s") == s).collect()}
        ema = {r.rn: r.ema for r in ind.ema(bars, ["s"], n).where(F.col("s") == s).collect()}
        assert sorted(sma) == sorted(ema) == list(range(n - 1, length))
        e = None
        for k in range(n - 1, length):
            e = statistics.fmean(c[:n]) if e is None else e + 2 / (n + 1) * (c[k] - e)
            assert sma[k] == pytest.approx(statistics.fmean(c[k - n + 1 : k + 1])) and ema[k] == pytest.approx(e, rel=1e-10)


def test_long_memory_over_many_parts(spark):
    rows = [("a", k, 1.0 + k % 5) for k in range(700)]
    df = spark.createDataFrame(rows, "s string, rn long, x double")
    got = {r.rn: r.y for r in decayed_sum(df, ["s"], "x", "y", 1 - 2 / 401, part=16).collect()}
    y = 0.0
    for k in range(700):
        y = y * (1 - 2 / 401) + 1.0 + k % 5
        assert got[k] == pytest.approx(y, rel=1e-9)


def test_rsi_special_values(spark):
    up = [("up", k * 60, 1.0 + k) for k in range(20)] + [("down", k * 60, 50.0 - k) for k in range(20)] + [("flat", k * 60, 7.0) for k in range(20)]
    df = index_rows(spark.createDataFrame(up, "s string, at long, close double"), ["s"], "at", 10_000)
    got = {}
    for r in ind.rsi(df, ["s"], 14).collect():
        got.setdefault(r.s, set()).add(r.rsi)
    assert got == {"up": {100.0}, "down": {0.0}, "flat": {50.0}}


def test_as_of(spark):
    rng = random.Random(8)
    right = [(rng.choice("ab"), rng.randrange(1000), float(n)) for n in range(60)] + [("a", None, 1.0), ("c", 5, 9.0)]
    left = [(rng.choice("abd"), rng.randrange(-50, 1100), n) for n in range(80)] + [("a", 3, 80), ("a", 3, 80)]
    for block in (37, 10_000):
        got = best_known(spark.createDataFrame(left, "k string, t long, id int"), spark.createDataFrame(right, "k string, at long, x double"), ["k"], "t", "at", block, ["at", "x"], ["x"])
        found = sorted((r.id, r.at, r.x) for r in got.collect() if r.x is not None)
        wanted = []
        for k, t, n in left:
            fits = [(a, x) for kk, a, x in right if kk == k and a is not None and a <= t]
            if fits:
                wanted.append((n, *max(fits)))
        assert found == sorted(wanted) and got.count() == len(left)


def test_latest_revision(spark):
    rows = [("k1", 1, "i1", 5.0), ("k1", 2, "i3", 6.0), ("k1", 2, "i2", 6.0), ("k2", 3, "i4", 1.0), ("k2", 3, "i5", 2.0), ("k3", None, "i6", 1.0)]
    got = {r.k: (r.at, r.id, r.ambiguous, r.revisions, r.superseded) for r in latest_revision(spark.createDataFrame(rows, "k string, at int, id string, v double"), ["k"], "at", ["v"], "id").collect()}
    assert got == {"k1": (2, "i2", False, 3, 1), "k2": (3, "i4", True, 2, 0)}


def test_require(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    assert require(df, F.col("x") > 0, "no").count() == 2
    with pytest.raises(Exception, match="too small"):
        require(df, F.col("x") > 1, "too small").collect()


def test_resample_guards(spark):
    rows = [("a", 0, 1.0, 3.0, 1.0, 2.0, 10.0, 5, 2.0), ("a", 1, 2.0, 4.0, 2.0, 3.0, 0.0, None, 3.0), ("a", 60, 1.0, 1.0, 1.0, 1.0, 0.0, 1, 1.0), ("b", 0, 1.0, 2.0, 1.0, 2.0, 1.0, 1, None)]
    df = spark.createDataFrame(rows, "s string, t long, open double, high double, low double, close double, volume double, trade_count int, vwap double")
    got = {(r.s, r.bucket): (r.open, r.high, r.low, r.close, r.volume, r.trade_count, r.vwap, r.complete) for r in resample(df, ["s"], F.floor(F.col("t") / 60), "t", F.lit(2)).collect()}
    assert got == {("a", 0): (1.0, 4.0, 1.0, 3.0, 10.0, None, 2.0, True), ("a", 1): (1.0, 1.0, 1.0, 1.0, 0.0, 1, None, False), ("b", 0): (1.0, 2.0, 1.0, 2.0, 1.0, 1, None, False)}
    assert df.where(is_valid_bar()).count() == 4


def test_pivot_and_back(spark):
    long = spark.createDataFrame([("k", "open", 1.0), ("k", "close", 2.0), ("k", "close", 3.0), ("j", "open", 4.0), ("j", "odd", 4.0)], "key string, f string, v double")
    wide = {r.key: (r.open, r.close, r.missing, r.duplicated) for r in pivot_fields(long, ["key"], "f", "v", ["open", "close"]).collect()}
    assert wide == {"k": (1.0, 3.0, [], ["close"]), "j": (4.0, None, ["close"], [])}
    assert unpivot_fields(pivot_fields(long, ["key"], "f", "v", ["open", "close"]), ["key"], ["open", "close"]).count() == 3


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 9, 12), ("a", 10, 11), ("a", 6, 6), ("b", 1, 2)], "k string, s int, e int")
    assert sorted(tuple(r) for r in merged_intervals(df, ["k"], "s", "e").collect()) == [("a", 1, 5), ("a", 9, 12), ("b", 1, 2)]


def test_quality(spark):
    df = spark.createDataFrame([("valid",), ("suspect",), ("odd",)], "q string")
    assert df.select(quality_name(F.max(quality_rank(F.col("q"))))).first()[0] == "suspect"


def test_best_known_never_looks_ahead(spark):
    """Late and revised rows, against reading all rows known at each moment."""
    rng = random.Random(9)
    right = []
    for k in range(300):
        at = rng.randrange(0, 1000)
        right.append((rng.choice("ab"), at, at + rng.choice([1, 1, 1, 40, 300]), k, float(k)))
    left = [(rng.choice("abz"), rng.randrange(-5, 1400), k) for k in range(200)]
    for block in (7, 100, 5000):
        got = best_known(spark.createDataFrame(left, "k string, t long, id int"), spark.createDataFrame(right, "k string, at long, seen long, n long, x double"), ["k"], "t", "seen", block, ["at", "seen", "n"], ["x"])
        want = {i: max(((a, s, n, x) for k2, a, s, n, x in right if k2 == k and s <= t), default=(None,) * 4)[3] for k, t, i in left}
        assert {r.id: r.x for r in got.collect()} == want
