"""Scalar functions as column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a text in a namespace given as a UUID."""
    space = namespace.replace("-", "")
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*[F.lit(c) for c in "89ab"]), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with its keys in order, without blanks, nulls left in."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def checksum(text: Column) -> Column:
    return F.sha2(text, 256)


def pad_cik(cik: Column) -> Column:
    """Digits of a company key padded to ten; null if it has none or more than ten."""
    digits = F.regexp_replace(F.regexp_replace(cik, r"\D", ""), "^0+(?=.)", "")
    return F.when(F.length(digits).between(1, 10), F.lpad(digits, 10, "0"))


def name_key(name: Column) -> Column:
    """A name for comparison: accents folded, lower case, only letters, digits and single blanks."""
    folded = F.translate(F.lower(name), "áàâãäåéèêëíìîïóòôõöúùûüñç", "aaaaaaeeeeiiiiooooouuuunc")
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def number_or_null(raw: Column, missing: tuple[str, ...] = (".", "", "NA")) -> Column:
    text = F.trim(raw)
    return F.when(~text.isin(*missing), F.regexp_replace(text, ",", "").try_cast("double"))


def isin_is_valid(code: Column) -> Column:
    """Whether a security code has twelve characters of the right kinds and the right check digit."""
    shaped = code.rlike(r"^[A-Z]{2}[A-Z0-9]{9}[0-9]\z")
    chars = F.filter(F.split(code, ""), lambda c: c != "")
    digits = F.filter(F.split(F.array_join(F.transform(chars, lambda c: F.conv(c, 36, 10)), ""), ""), lambda c: c != "")
    back = F.reverse(digits)
    total = F.aggregate(
        F.transform(back, lambda c, k: c.cast("int") * F.when(k % 2 == 1, 2).otherwise(1)),
        F.lit(0),
        lambda acc, v: acc + F.when(v > 9, v - 9).otherwise(v),
    )
    return F.coalesce(shaped & (total % 10 == 0), F.lit(False))


def day_bounds(first: Column, last: Column) -> tuple[Column, Column]:
    """Inclusive days as a half-open range of wall clock times."""
    return first.cast("timestamp_ntz"), F.date_add(last, 1).cast("timestamp_ntz")


def age_seconds(then: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / F.lit(1_000_000)
