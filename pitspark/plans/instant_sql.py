"""The meaning of the times of the test tables in SQL, for the oracles: forms by pattern, zones by the database's own."""

from __future__ import annotations

_NAMES = "'JAN', 'FEB', 'MAR', 'APR', 'MAY', 'JUN', 'JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC'"
_FULL = "JANUARY FEBRUARY MARCH APRIL MAY JUNE JULY AUGUST SEPTEMBER OCTOBER NOVEMBER DECEMBER SEPT".split()
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_ZONE = r"([A-Za-z]+|[+-]\d{2}:?\d{2}|[+-]\d{2})"
#: Pattern, and what its groups are.
_FORMS = [
    (rf"(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[Tt ]{_CLOCK} ?{_ZONE}?)?", "y m d hr mn sc f z"),
    (rf"(\d{{4}})(\d{{2}})(\d{{2}})(?:[Tt]?(\d{{2}})(\d{{2}})(\d{{2}})(?:\.(\d{{1,9}}))?{_ZONE}?)?", "y m d hr mn sc f z"),
    (rf"(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?: {_CLOCK}(?: ([A-Za-z]{{2}}))?(?: {_ZONE})?)?", "a b y hr mn sc f p z"),
    (rf"(?:[A-Za-z]+, )?(\d{{1,2}}) ([A-Za-z]+) (\d{{4}})(?: {_CLOCK}(?: {_ZONE})?)?", "d mon y hr mn sc f z"),
    (rf"([A-Za-z]+) (\d{{1,2}}), (\d{{4}})(?: {_CLOCK}(?: ([A-Za-z]{{2}}))?(?: {_ZONE})?)?", "mon d y hr mn sc f p z"),
    (r"(\d{1,2})-([A-Za-z]{3})-(\d{4}|\d{2})(?: (\d{1,2})[.:](\d{2})[.:](\d{2})(?: ([A-Za-z]{2}))?)?", "d mon y hr mn sc p"),
]
_PERIODS = [(r"(\d{4})-(\d{2})", "y m"), (r"(\d{4})-?[Qq](\d)", "y q"), (r"[Qq](\d)[ -](\d{4})", "q y"), (r"([A-Za-z]+) (\d{4})", "mon y"), (r"(\d{4})", "y")]
_PARTS = "y m d hr mn sc f p z mon a b q".split()
_HOURS = (
    "Z 0 UTC 0 GMT 0 WET 0 WEST 1 BST 1 CET 1 CEST 2 EET 2 EEST 3 MSK 3 EST -5 EDT -4 CST -6 CDT -5 MST -7 MDT -6 PST -8 PDT -7 PET -5 COT -5 "
    "CLT -4 CLST -3 ART -3 BRT -3 JST 9 KST 9 HKT 8 SGT 8 AEST 10 AEDT 11"
).split()


def instants(name: str, source: str, period: bool = False) -> str:
    """CTEs that end in ``name`` (id, ms) from a query with id, t and feed: epoch milliseconds, or null."""
    picks = []
    for pattern, parts in (_PERIODS if period else []) + _FORMS:
        groups = parts.split()
        own = ", ".join((f"nullif(regexp_extract(t, '^(?:{pattern})$', {groups.index(p) + 1}), '')" if p in groups else "null::varchar") + f" as {p}_" for p in _PARTS)
        picks.append(f"select id, zone, day_first, {own} from {name}_t where regexp_full_match(t, '{pattern}')")
    hours = ", ".join(f"'{k}': {v}" for k, v in zip(_HOURS[::2], _HOURS[1::2], strict=True))
    months = ", ".join(f"'{m}'" for m in [*_FULL])
    epoch = "" if period else f"""
      union all select id, case length(regexp_extract(t, '^\\d+')) when 10 then try_cast(t[:10] as bigint) * 1000 + coalesce(nullif(rpad(regexp_extract(t, '\\.(\\d{{1,3}})', 1), 3, '0'), '000')::bigint, 0)
        when 13 then try_cast(t as bigint) when 16 then try_cast(t as bigint) // 1000 else try_cast(t as bigint) // 1000000 end from {name}_t where regexp_full_match(t, '\\d{{10}}(\\.\\d{{1,9}})?|\\d{{13}}|\\d{{16}}|\\d{{19}}')"""
    first = "case when day_first is null then a_::int > 12 else day_first end"
    unclear = "(day_first is null and a_ is not null and a_::int <= 12 and b_::int <= 12 and a_ <> b_)"
    local = f"case when z_ is null then zone end"
    return f"""{name}_t as (select x.id, regexp_replace(x.t, '^\\s+|\\s+$', '', 'g') as t, fz.zone, fz.day_first from ({source}) x left join (select feed, min(zone) as zone, bool_or(day_first) as day_first from feed_zones group by 1) fz on x.feed = fz.feed where x.t is not null),
    {name}_p as materialized ({' union all '.join(picks)}),
    {name}_d as (select *, case when mon_ is not null then case when upper(mon_) in ({_NAMES}, {months}) then list_position([{_NAMES}], upper(mon_)[:3]) end when q_ is not null then case when q_::int between 1 and 4 then q_::int * 3 - 2 end
        when a_ is not null then case when {first} then b_::int else a_::int end else coalesce(m_::int, 1) end as mm,
      case when a_ is not null then case when {first} then a_::int else b_::int end else coalesce(d_::int, 1) end as dd,
      case when length(y_) = 2 then y_::int + case when y_::int < 70 then 2000 else 1900 end else y_::int end as yy,
      case when p_ is null then coalesce(hr_::int, 0) when upper(p_) in ('AM', 'PM') and hr_::int between 1 and 12 then hr_::int % 12 + case upper(p_) when 'PM' then 12 else 0 end end as hh, coalesce(mn_::int, 0) as mi, coalesce(sc_::int, 0) as ss,
      coalesce(rpad(f_[:3], 3, '0')::int, 0) as mil, {local} as own from {name}_q where not {unclear}),
    {name}_w as (select *, epoch(try_cast(printf('%04d-%02d-%02d', yy, mm, dd) as date))::bigint + hh * 3600 + mi * 60 + ss as wall, epoch(try_cast(printf('%04d-%02d-%02d', yy, mm, dd) as date))::bigint as midnight,
      case when z_[:1] in ('+', '-') then case when regexp_full_match(z_, '.\\d{{2}}:?\\d{{2}}') then case when z_[-2:]::int < 60 then z_[2:3]::int * 3600 + z_[-2:]::int * 60 end else z_[2:3]::int * 3600 end * case z_[:1] when '-' then -1 else 1 end
        when z_ is not null then map {{{hours}}}[upper(z_)] * 3600 end as shift
      from {name}_d where yy >= 1 and hh < 24 and mi < 60 and ss < 60),
    {name}_u as (select id, mil, wall, midnight, z_, shift, own, case when own is not null then epoch_us(timezone(own, make_timestamp(wall * 1000000))) // 1000000 end as guess from {name}_w where wall is not null),
    {name} as (select id, {'midnight * 1000' if period else f'''case when z_ is not null then (wall - shift) * 1000 + mil
      when epoch_us(timezone(own, make_timestamptz((guess - 3600) * 1000000))) // 1000000 = wall then (guess - 3600) * 1000 + mil
      when epoch_us(timezone(own, make_timestamptz(guess * 1000000))) // 1000000 = wall then guess * 1000 + mil end'''} as ms from {name}_u{epoch})""".replace(f"{name}_q where", f"{name}_p where")
