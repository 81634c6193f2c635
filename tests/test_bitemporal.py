"""Rectangles and their location, against brute force over random facts and points."""

import random

from pitspark.operators.bitemporal import locate, rectangles

DAY = 86_400_000_000
FACTS = "entity string, attribute string, fact_id string, period_end long, known long"
POINTS = "point_id long, entity string, at_day int, at_micros long"


def brute(facts, points):
    out = set()
    for pid, e, d, k in points:
        if None in (pid, e, d, k):
            continue
        best = {}
        for fe, attr, fid, p, known in facts:
            if None in (fe, attr, fid, p, known) or fe != e or known > k or p // DAY > d:
                continue
            rank = (-p, -known, fid)
            if attr not in best or rank < best[attr]:
                best[attr] = rank
        out |= {(pid, a, r[2]) for a, r in best.items()}
    return out


def random_case(seed):
    rng = random.Random(seed)
    facts = [(rng.choice("xy"), rng.choice("mn"), f"f{n:03}", rng.randrange(0, 40) * 30 * DAY + rng.choice([0, 0, 5]), rng.randrange(0, 60) * 25 * DAY + rng.choice([0, 1])) for n in range(120)]
    facts += facts[:10] + [(None, "m", "q1", 0, 0), ("x", "m", None, 0, 0), ("x", "m", "q2", None, 0), ("x", "m", "q3", 0, None)]
    points = [(n, rng.choice("xyz"), rng.randrange(-50, 1400), rng.randrange(-10, 1600) * DAY + rng.choice([0, 1, 2])) for n in range(150)] + [(900, None, 1, 1), (901, "x", None, 1), (902, "x", 1, None)]
    return facts, points


def test_against_brute_force(spark):
    for seed in (1, 2):
        facts, points = random_case(seed)
        regions = rectangles(spark.createDataFrame(facts, FACTS))
        got = [tuple(r) for r in locate(spark.createDataFrame(points, POINTS), regions).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(facts, points)


def test_rectangles_are_disjoint(spark):
    facts, _ = random_case(3)
    by = {}
    for r in rectangles(spark.createDataFrame(facts, FACTS)).collect():
        by.setdefault((r.entity, r.attribute), []).append(r)
    for own in by.values():
        for k, a in enumerate(own):
            for b in own[k + 1 :]:
                assert a.day_end <= b.day or b.day_end <= a.day or a.known_end <= b.known or b.known_end <= a.known or a.day >= a.day_end or b.day >= b.day_end


def test_empty(spark):
    none = spark.createDataFrame([], FACTS)
    assert rectangles(none).count() == 0
    assert locate(spark.createDataFrame([], POINTS), rectangles(none)).count() == 0


def test_one_hot_attribute(spark):
    facts = [("x", "m", f"f{n:05}", (n % 7) * DAY, n * 1000) for n in range(5000)]
    points = [(1, "x", 3, 10**9), (2, "x", 6, 2500_500)]
    assert {tuple(r) for r in locate(spark.createDataFrame(points, POINTS), rectangles(spark.createDataFrame(facts, FACTS))).collect()} == brute(facts, points)
