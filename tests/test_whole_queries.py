"""Queries over small tables of the test's own, where a plainer reading would give fewer or other rows."""

import datetime
import json

from pitspark.plans import basics, fundamentals, market

ZONES = [("us", "America/New_York", False), ("eu", "Europe/Madrid", True)]


def tables(spark, folder, **rows):
    """The folder with feed_zones and the given tables, each a schema and its rows."""
    for name, (schema, own) in {"feed_zones": ("feed string, zone string, day_first boolean", ZONES), **rows}.items():
        spark.createDataFrame(own, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def day(text):
    return datetime.date.fromisoformat(text)


def moment(text):
    return datetime.datetime.fromisoformat(text)


def test_macro_as_of_reads_every_form(spark, tmp_path):
    schema = "vintage_row_id long, series_id string, feed string, vintage_date date, observation_date string, raw_value string"
    rows = [
        (1, "A", "us", day("2013-01-01"), "2012-07-01", "10"),
        (2, "A", "us", day("2014-01-01"), "2012-Q3", "11"),
        (3, "A", "us", day("2014-01-01"), "2012-Q3", "11"),
        (3, "A", "us", day("2014-01-01"), "2012-Q3", "11"),
        (4, "A", "us", day("2021-01-01"), "2012-07-01", "12"),
        (5, "B", "eu", day("2013-01-01"), "2012-03-01", "1"),
        (6, "B", "eu", day("2013-02-01"), "01/03/2012", "2"),
        (7, "B", "us", day("2013-03-01"), "01/03/2012", "3"),
        (8, "C", "us", day("2013-01-01"), "Jan 2012", "5"),
        (9, "C", "us", day("2013-02-01"), " 2012-01-01\n", "6"),
        (10, "C", "us", day("2013-03-01"), "n/a", "7"),
    ]
    got = fundamentals.macro_as_of(spark, tables(spark, tmp_path, macro_vintages=(schema, rows))).collect()
    assert sorted(tuple(map(str, r)) for r in got) == [
        ("A", "2012-07-01", "2014-01-01", "2", "False", "3", "1"),
        ("B", "2012-01-03", "2013-03-01", "7", "False", "1", "0"),
        ("B", "2012-03-01", "2013-02-01", "6", "False", "2", "1"),
        ("C", "2012-01-01", "2013-02-01", "9", "False", "2", "1"),
    ]


BARS = "bar_id long, symbol string, feed string, t string, o double, h double, l double, c double, v long, n long, vw double, available_at timestamp_ntz"


def bar(bar_id, symbol, t, c, seen, v=10, n=1, vw=None):
    return (bar_id, symbol, "us", t, c, c, c, c, v, n, vw, moment(seen))


def test_val_multiples_takes_the_bar_of_the_valuation_date(spark, tmp_path):
    bars = [
        bar(1, "QX", "2020-01-02", 10.0, "2020-01-02 22:00"),
        bar(2, "QX", "01/03/2020", 11.0, "2020-01-20 22:00"),  # late
        bar(3, "QX", "2020-01-06T05:00:00Z", 12.0, "2020-01-06 22:00"),
        bar(4, "QX", "2020-01-06", 12.5, "2020-01-10 22:00"),  # another revision of the day
        bar(5, "QX", "2020-03-02", 99.0, "2020-03-02 22:00"),
        bar(6, "QX", "n/a", 77.0, "2020-01-05 22:00"),
        bar(7, "QY", "2020-01-02", 5.0, "2020-01-02 22:00"),
    ]
    requests = [
        (1, "equity-x", day("2020-01-06"), moment("2020-06-01 00:00")),  # after the last bar came
        (2, "equity-x", day("2020-01-06"), moment("2020-01-08 00:00")),  # before the revision
        (3, "equity-x", day("2020-01-05"), moment("2020-01-15 00:00")),  # before the late bar
        (4, "equity-x", day("2020-01-05"), moment("2020-01-25 00:00")),
        (5, "equity-x", day("2020-04-01"), moment("2020-02-01 00:00")),  # the late bar of an older day does not replace a newer one
        (6, "equity-x", day("2020-01-01"), moment("2020-06-01 00:00")),  # no bar yet
        (7, "equity-y", day("2020-01-06"), moment("2020-06-01 00:00")),  # no facts
    ]
    facts = [(f"o{k}", "equity-x", f"fundamental.{name}", value, "annual", moment("2019-12-31 00:00"), moment("2020-01-01 00:00"), "valid") for k, (name, value) in enumerate([("shares_outstanding", 100.0), ("net_income", 50.0)])]
    sf = tables(
        spark, tmp_path, daily_bars=(BARS, bars), valuation_requests=("request_id long, asset_id string, valuation_date date, known_at timestamp_ntz", requests),
        observations=("observation_id string, asset_id string, field_name string, obs_value double, frequency string, period_end timestamp_ntz, available_at timestamp_ntz, quality string", facts),
    )
    got = fundamentals.val_multiples(spark, sf).select("request_id", "symbol", "market_cap", "price_to_earnings", "price_to_sales").collect()
    assert sorted(map(tuple, got)) == [
        (1, "QX", 1250.0, 25.0, None),
        (2, "QX", 1200.0, 24.0, None),
        (3, "QX", 1000.0, 20.0, None),
        (4, "QX", 1100.0, 22.0, None),
        (5, "QX", 1250.0, 25.0, None),
        (7, "QY", None, None, None),
    ]


def test_funding_hours_are_those_of_the_event(spark, tmp_path):
    start = moment("2025-10-25 00:00")
    seen = lambda k, late=0: start + datetime.timedelta(hours=k + late, minutes=1)
    rows = [(k, "A", "eu", str(1761350400000 + 3_600_000 * k + 2093), float(k), seen(k)) for k in range(26)]
    rows[5] = (5, "A", "eu", rows[5][3], 5.0, seen(5, 30))  # late
    rows[7] = (7, "A", "eu", "25/10/2025 09:00:02", 7.0, seen(7))  # Madrid, two hours ahead
    rows += [(107, "A", "us", rows[0][3][:10], 100.0, seen(0, 2)), rows[3], (108, "A", "eu", "n/a", 9.0, seen(3)), (109, "A", "eu", "1761354000000.5", None, seen(1))]
    sf = tables(spark, tmp_path, funding_history=("funding_id long, instrument_name string, feed string, funding_timestamp string, interest_1h double, available_at timestamp_ntz", rows))
    rate = [100.0, *map(float, range(1, 26))]
    first = 1761350400 // 3600
    want = [("A", first + k, sum(rate[k - 23 : k + 1]), round(sum(rate[k - 23 : k + 1]) / 24, 12)) for k in range(23, 26)]
    assert sorted(map(tuple, market.der_funding_24h(spark, sf).collect())) == want


def test_bars_weighted_has_the_month_of_the_day(spark, tmp_path):
    bars = [
        bar(1, "QX", "2020-01-30", 10.0, "2020-01-30 22:00", 100, 1, 10.0),
        bar(2, "QX", "01/31/2020", 20.0, "2020-02-03 22:00", 300, 2, 20.0),  # came in the next month
        bar(3, "QX", "2020-01-31T05:00:00Z", 20.0, "2020-02-05 22:00", 100, 4, 22.0),  # the day again, revised
        bar(4, "QX", "2020-02-01T04:30:00Z", 90.0, "2020-01-31 10:00", 100, 8, 90.0),  # 31 January in New York, older
        bar(5, "QX", "2020-02-03", 30.0, "2020-02-03 22:00", 50, 16, None),
        bar(6, "QX", "n/a", 99.0, "2020-02-04 22:00", 50, 32, 99.0),
    ]
    got = market.bars_weighted(spark, tables(spark, tmp_path, daily_bars=(BARS, bars))).collect()
    assert sorted(tuple(map(str, r)) for r in got) == [
        ("QX", "2020-01-01", "20.0", "10.0", "200", "2", "5", "16.0"),
        ("QX", "2020-02-01", "30.0", "30.0", "50", "1", "16", "None"),
    ]


def test_company_facts_of_odd_documents(spark, tmp_path):
    facts = lambda unit: {"facts": {"us-gaap": {"Assets": {"units": {"USD": unit}}}}}
    one = {"val": 1.5, "accn": "a"}
    rows = [
        ("r1", "sec-companyfacts", json.dumps({"body": facts([None, one])})),
        ("r2", "sec-companyfacts", json.dumps({"body": json.dumps(facts([one]))})),  # the body is JSON text
        ("r3", "sec-companyfacts", json.dumps({"body": facts(one)})),  # one fact in place of a list
        ("r3", "sec-companyfacts", json.dumps({"body": facts(one)})),
        ("r4", "sec-companyfacts", "{"),
    ]
    sf = tables(spark, tmp_path, raw_records=("record_id string, source_id string, payload string", rows))
    assert sorted(map(tuple, basics.src_company_facts(spark, sf).collect())) == [(r, "us-gaap", "Assets", "USD", n, 1.5, "a") for r, n in (("r1", 1), ("r2", 0), ("r3", 0))]


def test_filings_and_points_of_odd_documents(spark, tmp_path):
    recent = {"filings": {"recent": {"accessionNumber": ["x", "y"], "filingDate": ["2020-01-02", ""], "form": ["8-K", "4"]}}}
    data = {"data": [[1000, 1.0, 2.0, 0.5, 1.5], None, [2000, 1.5, 2.0, 1.0, 1.0]]}
    rows = [
        ("s1", "sec-submissions", json.dumps({"body": recent})),
        ("s2", "sec-submissions", json.dumps({"body": json.dumps(recent)})),
        ("v1", "deribit-dvol", json.dumps({"result": data})),
        ("v2", "deribit-dvol", json.dumps({"result": json.dumps(data)})),
    ]
    sf = tables(spark, tmp_path, raw_records=("record_id string, source_id string, payload string", rows))
    got = sorted(map(tuple, basics.src_filing_index(spark, sf).collect()))
    assert got == [row for r in ("s1", "s2") for row in ((r, 0, "x", "2020-01-02", "8-K"), (r, 1, "y", None, "4"))]
    got = sorted(map(tuple, basics.src_volatility_points(spark, sf).collect()))
    assert got == [row for r in ("v1", "v2") for row in ((r, 0, 1000, 1.0, 1.5), (r, 2, 2000, 1.5, 1.0))]
