"""Valuation, readings, growth classes, ratios, scans and replays on small tables of the test's own."""

import datetime

import pytest
from pyspark.sql import functions as F

from pitspark.operators.conditions import replay, transitions
from pitspark.operators.diagnostics import fundamental_reading, growth_class, market_reading
from pitspark.operators.ratios import RATIOS, evaluate, history_statistics, percentile_rank, year_over_year
from pitspark.operators.scans import NotFound, bulk_get, get, scan
from pitspark.operators.valuation import percentile_rule, valuation_history, valuation_metrics, valuation_status

DAY = datetime.date(2020, 1, 1)


def test_every_valuation(spark):
    names = "id long, close_price double, shares_outstanding double, commercial_paper double, long_term_debt_current double, long_term_debt_noncurrent double, cash_and_cash_equivalents double, net_income double, stockholders_equity double, revenue double, operating_income double, depreciation_and_amortization double, operating_cash_flow double, capital_expenditures double"
    whole = (10.0, 100.0, 50.0, 100.0, 150.0, 200.0, 80.0, 500.0, 2000.0, 100.0, 10.0, 120.0, 20.0)
    rows = [(1, *whole), (2, *whole[:6], -1.0, 0.0, *whole[8:10], None, *whole[11:]), (3, 0.0, *whole[1:]), (4, *[None] * 13)]
    m = valuation_metrics(spark.createDataFrame(rows, names), ["id"])
    got = {(r.id, r.metric): (r.value, r.reason) for r in m.collect()}
    assert {k[1]: v[0] for k, v in got.items() if k[0] == 1} == {
        "market_cap": 1000.0, "financial_debt": 300.0, "enterprise_value": 1100.0, "price_to_earnings_latest_annual": 12.5, "price_to_book": 2.0, "price_to_sales_latest_annual": 0.5, "enterprise_value_to_sales_latest_annual": 0.55,
        "enterprise_value_to_ebit_latest_annual": 11.0, "enterprise_value_to_ebitda_latest_annual": 10.0, "free_cash_flow_yield_latest_annual": 0.1, "earnings_yield_latest_annual": 0.08,
    }
    assert got[2, "price_to_earnings_latest_annual"] == got[2, "price_to_book"] == (None, "invalid_denominator")
    assert got[2, "earnings_yield_latest_annual"] == (-0.001, None) and got[2, "enterprise_value_to_ebitda_latest_annual"] == (None, "ebitda_unavailable")
    assert got[3, "market_cap"] == (None, "invalid_denominator") and got[3, "financial_debt"] == (300.0, None)
    assert {v for k, v in got.items() if k[0] == 4 and "ebitda" not in k[1]} == {(None, "missing_input")}
    assert {r.id: (r.evaluated, r.status) for r in valuation_status(m, ["id"]).collect()} == {1: (11, "evaluated"), 2: (8, "partial"), 3: (1, "partial"), 4: (0, "not_evaluable")}


def test_valuation_history(spark):
    day = lambda k: DAY + datetime.timedelta(days=k)
    rows = [("a", day(1), 1, 5.0), ("a", day(1), 2, 4.0), ("a", day(2), 1, 6.0), ("a", day(3), 1, 3.0), ("a", day(4), 1, 1.0), ("a", day(4), 1, 2.0), ("b", day(1), 1, 1.0), ("c", day(1), 1, None)]
    h = valuation_history(spark.createDataFrame(rows, "k string, d date, known int, v double"), ["k"], "d", "known", "v")
    got = {r.k: r.asDict() for r in h.collect()}
    assert got.keys() == {"a", "b"} and got["b"]["previous_change"] is None and got["b"]["rank"] is None
    a = got["a"]
    assert (a["points"], a["first_value"], a["last_value"], a["least"], a["most"], a["value_range"], a["previous_change"], a["horizon_change"], a["rank"], a["ambiguous"], a["superseded"]) == (3, 4.0, 3.0, 3.0, 6.0, 3.0, -3.0, -1.0, 0.0, 1, 2)
    assert {r.k: r.outcome for r in percentile_rule(h, "at_or_below", 0.25).collect()} == {"a": "met", "b": "not_evaluable"}
    assert {r.k: r.outcome for r in percentile_rule(h, "at_or_above", 0.25).collect()}["a"] == "not_met"


def test_readings(spark):
    rows = [(1, 105.0, 100.0, 0.02, 0.02, 1.0, "valid"), (2, 105.0, 100.0, 0.02, 0.0, 4.0, "suspect"), (3, 90.0, 100.0, -0.05, 0.2, 0.0, "valid"), (4, None, None, 0.01, None, None, None)]
    got = {r.id: r for r in market_reading(spark.createDataFrame(rows, "id int, short double, long double, ret double, volatility double, relative_volume double, quality string"), ["id"]).collect()}
    assert (got[1].trend, got[1].momentum, got[1].score, got[1].verdict, got[1].confidence) == (100.0, 70.0, 88.0, "positive", 0.65)
    assert got[2].confidence == 0.5 and got[3].verdict == "negative" and got[3].trend_signal == -1.0
    assert (got[4].verdict, got[4].score, got[4].missing, got[4].quality) == ("insufficient_data", 0.0, "short,long,volatility,relative_volume", "partial")
    names = "id int, f string, net_margin double, liabilities_to_assets double, liabilities_to_equity double, revenue_yoy_growth double, net_income_yoy_change_rate double, age int"
    rows = [(1, "annual", 0.25, 0.4, 0.5, 0.15, 0.5, 400), (2, "annual", 0.1, 0.65, None, None, None, 0), (3, "quarterly", 0.1, 0.65, None, 0.025, None, 365), (4, "annual", None, 0.4, 0.5, 0.15, 0.5, 0)]
    got = {r.id: r for r in fundamental_reading(spark.createDataFrame(rows, names), ["id"], "f", "age").collect()}
    assert (got[1].score, got[1].confidence, got[1].verdict, got[1].quality) == (100.0, 1.0, "positive", "valid")
    assert got[2].verdict == got[4].verdict == "insufficient_data" and got[2].coverage == 0.55
    assert (got[3].coverage, got[3].recency, got[3].confidence, got[3].verdict) == (0.7, 0.5, 0.35, "neutral") and abs(got[3].score - 45.7143) < 1e-4
    x = spark.createDataFrame([(0.05, 0.05), (0.15, 0.1), (0.3, 0.1), (0.15, 0.01), (-0.1, 0.0)], "e double, r double")
    assert [r[0] for r in x.select(growth_class(F.col("e"), F.col("r"))).collect()] == ["slow_grower", "stalwart", "fast_grower", None, None]


def test_tax_rate_guards_the_return_on_capital(spark):
    names = ["operating_income", "income_tax", "pretax_income", "equity", "commercial_paper", "long_term_debt_current", "long_term_debt_noncurrent", "cash", "marketable_securities_current", "marketable_securities_noncurrent"]
    base = (100.0, 20.0, 80.0, 300.0, 10.0, 20.0, 70.0, 50.0, 25.0, 25.0)
    rows = [(1, *base), (2, base[0], 90.0, *base[2:]), (3, *base[:2], -5.0, *base[3:]), (4, *base[:3], 0.0, *base[4:]), (5, *base[:2], 0.0, *base[3:]), (6, None, *base[1:])]
    m = evaluate(spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names)), ["id"], [r for r in RATIOS if r.taxed])
    got = {(r.id, r.metric[:6]): (r.value, r.reason) for r in m.collect()}
    assert [got[k, "return"] for k in range(1, 7)] == [(0.25, None), (None, "tax_rate_out_of_range"), (None, "non_positive_denominator"), (None, "non_positive_denominator"), (None, "non_positive_denominator"), (None, "missing_inputs")]
    assert got[1, "effect"] == (0.25, None) and got[2, "effect"] == (None, "tax_rate_out_of_range")


def test_histories(spark):
    rows = [("a", 2018, "FY", DAY, 4.0), ("a", 2019, "FY", DAY.replace(year=2021), -2.0), ("a", 2020, "FY", DAY.replace(year=2022), 3.0), ("b", 2019, "FY", DAY, 1.0), ("b", 2019, "FY", DAY, 2.0)]
    df = spark.createDataFrame(rows, "k string, y int, p string, d date, v double")
    assert sorted((r.k, r.y, r.growth, r.change_rate) for r in year_over_year(df, ["k"], "y", "p", "v").collect()) == [("a", 2019, -1.5, -1.5), ("a", 2020, None, 2.5)]
    a = next(r for r in history_statistics(df, ["k"], "d", "v").collect() if r.k == "a")
    assert (a.points, a.previous_change, a.horizon_change, a.horizon_rate, a.value_range) == (3, 5.0, -1.0, -0.25, 6.0)
    assert [(r.k, r.prior, r.rank) for r in percentile_rank(df, ["k"], "d", "v", 2).collect()] == [("a", 2, 0.5)]


def test_scans(spark):
    rows = spark.createDataFrame([(1, "a", 5, '{"w":"20"}'), (2, "b", 6, None), (3, None, 7, '{"w":"5"}')], "id int, s string, n int, parameters string")
    ids = lambda **k: sorted(r.id for r in scan(rows, **k).collect())
    assert ids(equal={"s": "a"}) == [1] and ids(among={"s": []}) == [] and ids(among={"s": ["a", "b"]}) == [1, 2]
    assert ids(at_least={"n": 6}, at_most={"n": 7}) == [2, 3] and ids(before={"n": 6}) == [1] and ids(not_null=["s"]) == [1, 2]
    assert ids(parameters={"w": "20"}) == [1] and ids(matching={"s": "^b"}) == [2] and ids() == [1, 2, 3]
    assert get(rows, "id", 2)["s"] == "b"
    with pytest.raises(NotFound):
        get(rows, "id", 9)
    with pytest.raises(ValueError):
        get(rows.unionAll(rows.withColumn("n", F.lit(0))), "id", 1)
    assert {r.id: r.found for r in bulk_get(rows, "id", spark.createDataFrame([(1,), (1,), (9,), (None,)], "id int")).collect()} == {1: True, 9: False}


def test_replay(spark):
    e = [("a", k, x, h) for k, (x, h) in enumerate([("met", "met"), ("met", "met"), ("not_met", "met"), ("not_met", "not_met"), ("not_evaluable", "not_evaluable"), ("met", "met"), ("met", "met")])] + [("b", 0, "not_met", "not_met")]
    df = spark.createDataFrame(e, "stream string, at long, entry string, hold string")
    got = {r.stream: (r.evaluations, r.matched, r.not_evaluable, r.match_rate, r.opened, r.closed, r.first_at, r.last_at) for r in replay(df, 2, 1).collect()}
    assert got == {"a": (7, 4, 1, round(4 / 7, 6), 2, 1, 0, 6), "b": (1, 0, 0, 0.0, 0, 0, 0, 0)}
    events = spark.createDataFrame([("a", 1, "opened"), ("a", 3, "closed"), ("a", 6, "opened")], "stream string, at long, event string")
    assert sorted(map(tuple, transitions(events).collect())) == [("a", 1, 3), ("a", 6, None)]
