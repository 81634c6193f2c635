"""Times written in many forms as one instant: shape masks, one parser per mask, zone transition tables.

A text is reduced to its mask (digits to ``9``, letters to ``A``, anything else as it is). Each distinct mask of a
batch is compiled once to a layout of fixed character positions, and all texts of that mask are then read as columns
of one byte matrix, without a loop over the rows. Wall clock times are moved to UTC through tables of a zone's
transitions, kept for each version of the zone data.
"""

from __future__ import annotations

import os
import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import TZPATH, ZoneInfo, ZoneInfoNotFoundError

import numpy as np

#: Texts up to so many characters are read together; longer ones in classes of about the same length.
WIDTH = 48
#: Transition tables reach from 1900 to 2100; the few times beyond are asked of the zone one by one.
TABLE_FROM, TABLE_TO = -2_208_988_800, 4_102_444_800

#: Folders with zone data, by version; None is the data that Python finds.
_ZONE_DATA: dict[str, str | None] = {}

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = ord("9")
_CLASS[65:91] = ord("A")
_CLASS[97:123] = ord("A")

_CLOCK = r"(?P<H>9{1,2}):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?"
_ZONE = r"(?P<z>A+|[+-]99:?99|[+-]99)"
_LAYOUTS = [
    # epoch seconds (with a fraction), milliseconds, microseconds, nanoseconds
    r"(?P<e>9{10})(?:\.(?P<f>9{1,9}))?",
    r"(?P<e>9{13}|9{16}|9{19})",
    # 2025-01-31T10:20:30.123Z and its kin; a date alone means its midnight
    rf"(?P<y>9{{4}})-(?P<m>99)-(?P<d>99)(?:(?P<t>[A ]){_CLOCK} ?{_ZONE}?)?",
    # 20250131, 20250131102030, 20250131T102030Z
    rf"(?P<y>9{{4}})(?P<m>99)(?P<d>99)(?:(?P<t>A)?(?P<H>99)(?P<M>99)(?P<S>99)(?:\.(?P<f>9{{1,9}}))?{_ZONE}?)?",
    # 31/01/2025 or 01/31/2025
    rf"(?P<a>9{{1,2}})/(?P<b>9{{1,2}})/(?P<y>9{{4}})(?: {_CLOCK}(?: (?P<p>AA))?(?: {_ZONE})?)?",
    # Fri, 31 Jan 2025 10:20:30 GMT
    rf"(?:A+, )?(?P<d>9{{1,2}}) (?P<mon>A+) (?P<y>9{{4}})(?: {_CLOCK}(?: {_ZONE})?)?",
    # Jan 31, 2025 10:20:30 AM EST
    rf"(?P<mon>A+) (?P<d>9{{1,2}}), (?P<y>9{{4}})(?: {_CLOCK}(?: (?P<p>AA))?(?: {_ZONE})?)?",
    # 31-JAN-25 10.20.30 AM, 31-Jan-2025
    r"(?P<d>9{1,2})-(?P<mon>AAA)-(?P<y>9999|99)(?: (?P<H>9{1,2})[.:](?P<M>99)[.:](?P<S>99)(?: (?P<p>AA))?)?",
]
#: Forms that state a period, read only where a period's first day is asked for.
_PERIODS = [
    r"(?P<y>9{4})-(?P<m>99)",
    r"(?P<y>9{4})-?(?P<q>A9)",
    r"(?P<q>A9)[ -](?P<y>9{4})",
    r"(?P<mon>A+) (?P<y>9{4})",
    r"(?P<y>9{4})",
]
_COMPILED = [re.compile(x) for x in _LAYOUTS]
_COMPILED_PERIODS = [re.compile(x) for x in _PERIODS]

_MONTHS = {
    name: k + 1
    for k, names in enumerate(
        "JAN JANUARY|FEB FEBRUARY|MAR MARCH|APR APRIL|MAY|JUN JUNE|JUL JULY|AUG AUGUST|SEP SEPT SEPTEMBER|OCT OCTOBER|NOV NOVEMBER|DEC DECEMBER".split("|")
    )
    for name in names.split()
}
#: Fixed meaning, in hours, of the zone abbreviations that a text may carry.
_ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 1, "BST": 1, "CET": 1, "CEST": 2, "EET": 2, "EEST": 3, "MSK": 3,
    "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "PET": -5, "COT": -5,
    "CLT": -4, "CLST": -3, "ART": -3, "BRT": -3, "JST": 9, "KST": 9, "HKT": 8, "SGT": 8, "AEST": 10, "AEDT": 11,
}


@lru_cache(maxsize=4096)
def _plan(mask: str, period: bool) -> dict[str, tuple[int, int]] | None:
    for pattern in (_COMPILED_PERIODS if period else []) + _COMPILED:
        if m := pattern.fullmatch(mask):
            return {k: m.span(k) for k, v in m.groupdict().items() if v is not None}
    return None


@lru_cache(maxsize=1)
def installed_version() -> str:
    """The version of the zone data that Python finds, e.g. '2025b'; 'unknown' if it doesn't say."""
    for folder in TZPATH:
        try:
            with open(os.path.join(folder, "tzdata.zi"), encoding="ascii") as f:
                if m := re.match(r"# version (\w+)", f.readline()):
                    return m[1]
        except OSError:
            continue
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "unknown"


def add_zone_data(version: str, folder: str) -> None:
    """Makes the compiled zone files in a folder known under a version."""
    _ZONE_DATA[version] = folder


@lru_cache(maxsize=1024)
def _zone(zone: str, version: str) -> ZoneInfo | None:
    folder = _ZONE_DATA.get(version)
    try:
        if folder is None:
            return ZoneInfo(zone)
        if not re.fullmatch(r"[A-Za-z0-9_+-]+(?:/[A-Za-z0-9_+-]+)*", zone):
            return None
        with open(os.path.join(folder, zone), "rb") as f:
            return ZoneInfo.from_file(f, key=zone)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _offset(z: ZoneInfo, s: int) -> int:
    return round((_EPOCH + timedelta(seconds=s)).astimezone(z).utcoffset().total_seconds())


@lru_cache(maxsize=1024)
def zone_table(zone: str, version: str) -> tuple[np.ndarray, np.ndarray] | None:
    """UTC seconds at which the zone's offset changes, and the offsets before the first and after each of them, in a
    version of the zone data. None for a name that is no zone. Found by days, then to the second by halving.
    """
    if (z := _zone(zone, version)) is None:
        return None
    at, offsets = [], [_offset(z, TABLE_FROM)]
    for day in range(TABLE_FROM // 86_400, TABLE_TO // 86_400):
        if (new := _offset(z, day * 86_400 + 86_400)) != (old := offsets[-1]):
            low, high = day * 86_400, day * 86_400 + 86_400
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if _offset(z, mid) == old else (low, mid)
            at.append(high)
            offsets.append(new)
    return np.array(at, dtype=np.int64), np.array(offsets, dtype=np.int64)


def _offsets(utc: np.ndarray, zone: str, version: str) -> np.ndarray:
    at, offsets = zone_table(zone, version)
    out = offsets[np.searchsorted(at, utc, side="right")]
    for k in np.flatnonzero((utc < TABLE_FROM + 86_400) | (utc >= TABLE_TO - 86_400)):
        if -62_135_510_400 <= utc[k] <= 253_402_214_400:  # what a datetime can hold in any zone
            out[k] = _offset(_zone(zone, version), int(utc[k]))
    return out


def wall_to_utc(wall: np.ndarray, zone: str, version: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """UTC seconds of wall clock seconds, and which of them exist; of two instants the earlier one."""
    version = version or installed_version()
    if zone_table(zone, version) is None:
        return wall, np.zeros(len(wall), dtype=bool)
    best, ok = np.zeros(len(wall), dtype=np.int64), np.zeros(len(wall), dtype=bool)
    for o in (_offsets(wall - 86_400, zone, version), _offsets(wall + 86_400, zone, version)):
        u = wall - o
        fits = _offsets(u, zone, version) == o
        best = np.where(fits & (~ok | (u < best)), u, best)
        ok |= fits
    return best, ok


def _number(chars: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(chars), dtype=np.int64)
    for k in range(*span):
        out = out * 10 + (chars[:, k].astype(np.int64) - 48)
    return out


def _words(chars: np.ndarray, span: tuple[int, int], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """The number that each word stands for, and whether it is known; each distinct word is looked up once."""
    part = np.ascontiguousarray(chars[:, span[0] : span[1]])
    words, where = np.unique(part.view(f"S{span[1] - span[0]}").ravel(), return_inverse=True)
    found = [known.get(w.decode("ascii").upper()) for w in words]
    return np.array([f or 0 for f in found], dtype=np.int64)[where], np.array([f is not None for f in found])[where]


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Days since the epoch, and which dates exist."""
    ok = (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1)
    months = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    return first + d - 1, ok & (d <= after - first)


def _read(chars: np.ndarray, plan: dict, zones: np.ndarray, day_first: np.ndarray, period: bool, version: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    n = len(chars)
    num = lambda k, default=0: _number(chars, plan[k]) if k in plan else np.full(n, default, dtype=np.int64)
    ok = np.ones(n, dtype=bool)
    ms = np.zeros(n, dtype=np.int64)
    if "f" in plan:
        a, b = plan["f"]
        ms = _number(chars, (a, min(b, a + 3))) * 10 ** max(0, 3 - (b - a))
    if "e" in plan:
        if period:
            return ms, np.zeros(n, dtype=bool)
        digits = plan["e"][1] - plan["e"][0]
        e = num("e")
        return (e * 1000 + ms if digits == 10 else e // 10 ** (digits - 13)), ok
    y, m, d = num("y"), num("m", 1), num("d", 1)
    if "y" in plan and plan["y"][1] - plan["y"][0] == 2:
        y = y + np.where(y < 70, 2000, 1900)
    if "mon" in plan:
        m, known = _words(chars, plan["mon"], _MONTHS)
        ok &= known
    if "q" in plan:
        a, b = plan["q"]
        quarter = _number(chars, (a + 1, b))
        ok &= np.isin(chars[:, a], [ord("Q"), ord("q")]) & (quarter >= 1) & (quarter <= 4)
        m = quarter * 3 - 2
    if "a" in plan:  # day_first: 1, 0, or -1 where the feed doesn't say
        a, b = num("a"), num("b")
        first = np.where(day_first >= 0, day_first == 1, a > 12)
        ok &= (day_first >= 0) | (a > 12) | (b > 12) | (a == b)
        d, m = np.where(first, a, b), np.where(first, b, a)
    if "t" in plan:
        ok &= np.isin(chars[:, plan["t"][0]], [ord("T"), ord("t"), ord(" ")])
    days, exists = _days(y, m, d)
    ok &= exists
    hour, minute, second = num("H"), num("M"), num("S")
    if "p" in plan:
        half, known = _words(chars, plan["p"], {"AM": 0, "PM": 12})
        ok &= known & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + half
    ok &= (hour < 24) & (minute < 60) & (second < 60)
    if period:
        return days * 86_400_000, ok
    wall = days * 86_400 + hour * 3600 + minute * 60 + second
    if "z" in plan:
        a, b = plan["z"]
        if chars[0, a] in (43, 45):  # the sign belongs to the mask, so it is the same in all rows
            h, mm = _number(chars, (a + 1, a + 3)), _number(chars, (b - 2, b)) if b - a > 3 else 0
            ok &= (h < 19) & (mm < 60) if b - a > 3 else h < 19
            shift = (h * 3600 + mm * 60) * (1 if chars[0, a] == 43 else -1)
        else:
            hours, known = _words(chars, (a, b), _ABBREVIATIONS)
            shift = hours * 3600
            ok &= known
        utc = wall - shift
    else:
        utc = np.zeros(n, dtype=np.int64)
        for zone in {z for z in zones if z is not None}:
            at = np.flatnonzero(zones == zone)
            utc[at], there = wall_to_utc(wall[at], zone, version)
            ok[at] &= there
        ok &= np.array([z is not None for z in zones], dtype=bool)
    return utc * 1000 + ms, ok


def parse_instants(texts: list, zones: list, day_first: list, period: bool = False, version: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Epoch milliseconds of texts, and which of them state an instant.

    zones: for each text the zone it means when it names none (None: such a text states no instant). day_first: for
    each whether numeric dates with slashes put the day first (None: only dates that can be read one way count).
    period: the first day of the stated day, month, quarter or year, at midnight UTC. Null, empty, unreadable or
    impossible times, unknown zones and wall clock times that never occur are no instants. Finer digits are cut off.
    version: of the zone data (see ``add_zone_data``); that which Python finds, if none is given.
    """
    n = len(texts)
    out, ok = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    clean = [b"" if t is None else t.strip().encode("ascii", "replace") for t in texts]
    lengths = np.array([len(t) for t in clean], dtype=np.int64)
    width = np.maximum(WIDTH, 1 << np.frexp(np.maximum(lengths - 1, 1).astype(float))[1])
    zones_of = np.array(zones, dtype=object)
    first_of = np.array([-1 if x is None or x != x else int(x) for x in day_first], dtype=np.int64)
    for wide in np.unique(width[lengths > 0]).tolist():
        rows = np.flatnonzero((width == wide) & (lengths > 0))
        chars = np.array([clean[k] for k in rows], dtype=f"S{wide}").view(np.uint8).reshape(len(rows), wide)
        masks, where = np.unique(_CLASS[chars].view(f"S{wide}").ravel(), return_inverse=True)
        order = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[order], np.arange(len(masks) + 1))
        for k, mask in enumerate(masks):
            if (plan := _plan(mask.decode("ascii"), period)) is None:
                continue
            own = order[ends[k] : ends[k + 1]]
            at = rows[own]
            out[at], ok[at] = _read(chars[own], plan, zones_of[at], first_of[at], period, version)
    return out, ok
