"""Nearest records against brute force."""

import random

import pytest

from pitspark.llm.nearest import nearest_in_time

LEFT, RIGHT = "left_id long, entity string, at long", "right_id long, entity string, at long, left_id int"


def brute(left, right, tolerance):
    out = {}
    for i, e, t in left:
        fits = [(abs(a - t), a, j) for j, f, a, _ in right if None not in (j, f, a) and f == e and abs(a - t) <= tolerance] if None not in (i, e, t) else []
        if fits:
            out[i] = min(fits)[2]
    return out


@pytest.mark.parametrize("tolerance", [1, 7, 90])
def test_against_brute_force(spark, tolerance):
    rng = random.Random(tolerance)
    left = [(n, rng.choice("ab"), rng.randrange(-300, 300)) for n in range(200)] + [(900, None, 1), (901, "a", None), (None, "a", 1)]
    right = [(n, rng.choice("abc"), rng.randrange(-300, 300), 1) for n in range(150)] + [(500, "a", None, 1), (None, "a", 3, 1), (501, None, 3, 1)]
    right += [(n + 1000, e, a, x) for n, e, a, x in right[:40] if n is not None]  # ties in time
    got = [tuple(r) for r in nearest_in_time(spark.createDataFrame(left + left[:9], LEFT), spark.createDataFrame(right + right[:9], RIGHT), tolerance).collect()]
    assert len(got) == len({g[0] for g in got}) and dict(got) == brute(left, right, tolerance)


def test_bounds_and_ties(spark):
    left = spark.createDataFrame([(1, "a", 100), (2, "a", 500)], LEFT)
    right = spark.createDataFrame([(7, "a", 110, 0), (8, "a", 90, 0), (6, "a", 90, 0), (9, "a", 511, 0)], RIGHT)
    assert {tuple(r) for r in nearest_in_time(left, right, 10).collect()} == {(1, 6)}  # the earlier, then the smaller id; 11 away is too far
    assert {tuple(r) for r in nearest_in_time(left, right, 11).collect()} == {(1, 6), (2, 9)}
    assert nearest_in_time(left.limit(0), right, 10).count() == nearest_in_time(left, right.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        nearest_in_time(left, right, 0)
