"""Fetching over HTTPS for the landing step: bounded size, few attempts, honouring what the server asks for."""

from __future__ import annotations

import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

#: Statuses worth another attempt, pauses between attempts, longest pause a server may ask for.
RETRY_STATUSES = frozenset({408, 429, *range(500, 600)})
PAUSES = (0.1, 0.2)
LONGEST_PAUSE = 5.0


@dataclass(frozen=True)
class Response:
    status: int
    headers: dict[str, str]
    body: bytes
    truncated: bool


def fetch(url: str, form: dict[str, str] | None = None, headers: dict[str, str] | None = None, most_bytes: int = 50_000_000, timeout: float = 30.0, opener: Callable | None = None, sleep: Callable[[float], None] = time.sleep) -> Response:
    """GET, or POST of a form; raises the last error when every attempt failed."""
    if urllib.parse.urlsplit(url).scheme != "https":
        raise ValueError("only https is fetched")
    data = urllib.parse.urlencode(form).encode() if form is not None else None
    for attempt in range(len(PAUSES) + 1):
        try:
            with (opener or urllib.request.urlopen)(urllib.request.Request(url, data=data, headers=headers or {}), timeout=timeout) as r:
                body = r.read(most_bytes + 1)
                return Response(r.status, {k.lower(): v for k, v in r.headers.items()}, body[:most_bytes], len(body) > most_bytes)
        except urllib.error.HTTPError as e:
            if e.code not in RETRY_STATUSES or attempt == len(PAUSES):
                raise
            asked = e.headers.get("Retry-After", "") if e.headers else ""
            sleep(min(float(asked), LONGEST_PAUSE) if asked.isdigit() else PAUSES[attempt])
        except (urllib.error.URLError, TimeoutError):
            if attempt == len(PAUSES):
                raise
            sleep(PAUSES[attempt])
    raise AssertionError("unreachable")


def chunks(start: int, end: int, step: int, most: int) -> list[tuple[int, int]]:
    """[start, end) in half-open pieces of at most ``most`` steps, for providers that bound a request."""
    width = step * most
    return [(a, min(a + width, end)) for a in range(start, end, width)]


def pages(first: Callable[[str | None], tuple[list, str | None]]) -> list:
    """All items of a paged answer; a token that comes again is an error, not an endless loop."""
    items, token, seen = [], None, set()
    while True:
        part, token = first(token)
        items.extend(part)
        if token is None:
            return items
        if token in seen:
            raise ValueError("the pages repeat")
        seen.add(token)
