"""Times in mixed forms, against zoneinfo and by hand."""

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest

from pitspark.functions.instants import add_zone_data, installed_version, parse_instants, wall_to_utc, zone_table
from pitspark.operators.normalise_times import with_instant


def one(text, zone="UTC", day_first=False, period=False):
    ms, ok = parse_instants([text], [zone], [day_first], period)
    return int(ms[0]) if ok[0] else None


def ms(*parts, tz=timezone.utc, extra=0):
    return round(datetime(*parts, tzinfo=tz).timestamp() * 1000) + extra


@pytest.mark.parametrize(
    ("text", "zone", "day_first", "expected"),
    [
        ("1761349936788", "UTC", False, 1761349936788),
        ("1761349936", "UTC", False, 1761349936000),
        ("1761357664.960", "UTC", False, 1761357664960),
        ("1761368428562268", "UTC", False, 1761368428562),
        (" 2025-10-25T03:01:09Z\n", "Asia/Tokyo", False, ms(2025, 10, 25, 3, 1, 9)),
        ("2025-10-25T12:01:19.296391Z", "UTC", False, ms(2025, 10, 25, 12, 1, 19, extra=296)),
        ("2025-10-25T10:00:30+02:00", "UTC", False, ms(2025, 10, 25, 8, 0, 30)),
        ("2025-10-25 23:28:17+0530", "UTC", False, ms(2025, 10, 25, 17, 58, 17)),
        ("20251025T095438Z", "UTC", False, ms(2025, 10, 25, 9, 54, 38)),
        ("20200704162928", "America/New_York", False, ms(2020, 7, 4, 20, 29, 28)),
        ("Sat, 25 Oct 2025 08:01:03 GMT", "UTC", False, ms(2025, 10, 25, 8, 1, 3)),
        ("Oct 25, 2025 8:19:39 AM EDT", "UTC", False, ms(2025, 10, 25, 12, 19, 39)),
        ("Oct 25, 2025 12:00:00 AM UTC", "UTC", False, ms(2025, 10, 25)),
        ("28-DEC-16 06.56.20 PM", "UTC", False, ms(2016, 12, 28, 18, 56, 20)),
        ("03/04/2025 01:00:00", "UTC", True, ms(2025, 4, 3, 1)),
        ("03/04/2025 01:00:00", "UTC", False, ms(2025, 3, 4, 1)),
        ("03/04/2025 01:00:00", "UTC", None, None),
        ("13/04/2025 01:00:00", "UTC", None, ms(2025, 4, 13, 1)),
        ("2025-03-10", "America/New_York", False, ms(2025, 3, 10, 4)),
        # a clock time that occurs twice is the earlier instant, one that never occurs is none
        ("2025-11-02 01:30:00", "America/New_York", False, ms(2025, 11, 2, 5, 30)),
        ("2025-03-09 02:30:00", "America/New_York", False, None),
        ("2025-03-09 02:30:00", None, False, None),
        ("2025-03-09 02:30:00", "Nowhere/Land", False, None),
        ("0000-00-00T00:00:00Z", "UTC", False, None),
        ("20xx-13-45", "UTC", False, None),
        ("2025-02-30", "UTC", False, None),
        ("2025-01-01T24:00:00Z", "UTC", False, None),
        ("Oct 25, 2025 13:00:00 PM UTC", "UTC", False, None),
        ("n/a", "UTC", False, None),
        ("", "UTC", False, None),
        (None, "UTC", False, None),
        ("9" * 5000, "UTC", False, None),
        ("2025-10-25X03:01:09Z", "UTC", False, None),
    ],
)
def test_forms(text, zone, day_first, expected):
    assert one(text, zone, day_first) == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [("2012-05", (2012, 5, 1)), ("2012-Q3", (2012, 7, 1)), ("Q4 2012", (2012, 10, 1)), ("Jan 2012", (2012, 1, 1)), ("01-Apr-2012", (2012, 4, 1)), ("20120501", (2012, 5, 1)), ("2012-05-01T00:00:00Z", (2012, 5, 1)), ("Q5 2019", None), ("2019-00-01", None), ("n.d.", None)],
)
def test_periods(text, expected):
    assert one(text, "Asia/Tokyo", False, True) == (ms(*expected) if expected else None)


@pytest.mark.parametrize("zone", ["America/New_York", "Europe/Madrid", "America/Lima", "Asia/Tokyo", "Australia/Lord_Howe"])
def test_zone_table_against_zoneinfo(zone):
    rng, z = random.Random(3), ZoneInfo(zone)
    walls = [rng.randrange(0, 2_500_000_000) for _ in range(2000)]
    at, _ = zone_table(zone, installed_version())
    walls += [int(t) + d for t in at[(at > 0) & (at < 2_500_000_000)] for d in (-7200, -3600, -1, 0, 1, 3599, 3600, -18000, 36000)]
    got, ok = wall_to_utc(np.array(walls), zone)
    for w, g, exists in zip(walls, got, ok, strict=True):
        naive = datetime(1970, 1, 1) + timedelta(seconds=w)
        found = {int(naive.replace(tzinfo=z, fold=f).timestamp()) for f in (0, 1)}
        real = {u for u in found if datetime.fromtimestamp(u, z).replace(tzinfo=None) == naive}
        assert exists == bool(real) and (not real or g == min(real))


def test_years_beyond_the_tables():
    texts = ["2250-07-01 12:00:00", "2250-01-01 12:00:00", "1850-07-01 12:00:00", "9998-07-01 12:00:00"]
    ms, ok = parse_instants(texts, ["America/New_York"] * 4, [None] * 4)
    z = ZoneInfo("America/New_York")
    assert ok.all() and [int(datetime.fromisoformat(t).replace(tzinfo=z).timestamp()) for t in texts] == [int(x) // 1000 for x in ms]


def test_long_texts_are_read():
    day = "Wednesday, 30 September 2025 23:59:59.123456789 +00:00"
    texts = [" " * 5000 + day + "\n" * 5000, day, "x" * 100_000, "2025-01-01", "1" * 5000]
    ms, ok = parse_instants(texts, ["UTC"] * 5, [None] * 5)
    assert ok.tolist() == [True, True, False, True, False] and ms[0] == ms[1] == 1759276799123


def test_versions_of_the_zone_data(tmp_path):
    """The same text under two versions of a zone's rules; names outside the folder are no zones."""
    import zoneinfo
    from pathlib import Path

    found = next((Path(d) / "Etc/GMT+3" for d in zoneinfo.TZPATH if (Path(d) / "Etc/GMT+3").exists()), None)
    if found is None:
        import tzdata

        found = Path(tzdata.__file__).parent / "zoneinfo/Etc/GMT+3"
    (tmp_path / "Own").mkdir()
    (tmp_path / "Own/Zone").write_bytes(found.read_bytes())
    (tmp_path / "Europe").mkdir()
    (tmp_path / "Europe/Madrid").write_bytes(found.read_bytes())
    add_zone_data("own-1", str(tmp_path))
    read = lambda zone, version: [x.tolist() for x in parse_instants(["2025-01-31 10:00:00"], [zone], [None], version=version)]
    at = 1738317600000
    assert read("Europe/Madrid", None) == [[at - 3_600_000], [True]]
    assert read("Europe/Madrid", "own-1") == read("Own/Zone", "own-1") == [[at + 3 * 3_600_000], [True]]
    assert read("Europe/Paris", "own-1")[1] == read("../Own/Zone", "own-1")[1] == [False]


def test_columns(spark):
    rows = [(1, "2025-01-01 00:00:00", "ny", 7), (2, None, "ny", 7), (3, "2025-01-01T00:00:00Z", "unknown", 7), (3, "2025-01-01 00:00:00", None, 7)]
    df = spark.createDataFrame(rows, "id int, t string, feed string, zone int")  # zone clashes with the reference's column
    zones = spark.createDataFrame([("ny", "America/New_York", False), ("ny", "America/New_York", False)], "feed string, zone string, day_first boolean")
    got = sorted((r.id, r.utc_ms, r.zone) for r in with_instant(df, "t", "feed", zones).collect() if r.utc_ms is not None)
    assert got == [(1, ms(2025, 1, 1, 5), 7), (3, ms(2025, 1, 1), 7)]
    assert with_instant(df.limit(0), "t", "feed", zones).count() == 0
