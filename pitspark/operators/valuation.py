"""Valuation of a company at a moment: metrics of a price and annual facts, each with a value or the reason it has none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Metrics and the inputs they need.
DEBT = ["commercial_paper", "long_term_debt_current", "long_term_debt_noncurrent"]
CAP = ["close_price", "shares_outstanding"]
ENTERPRISE = [*CAP, *DEBT, "cash_and_cash_equivalents"]
METRICS: dict[str, list[str]] = {
    "market_cap": CAP,
    "financial_debt": DEBT,
    "enterprise_value": ENTERPRISE,
    "price_to_earnings_latest_annual": [*CAP, "net_income"],
    "price_to_book": [*CAP, "stockholders_equity"],
    "price_to_sales_latest_annual": [*CAP, "revenue"],
    "enterprise_value_to_sales_latest_annual": [*ENTERPRISE, "revenue"],
    "enterprise_value_to_ebit_latest_annual": [*ENTERPRISE, "operating_income"],
    "enterprise_value_to_ebitda_latest_annual": [*ENTERPRISE, "operating_income", "depreciation_and_amortization"],
    "free_cash_flow_yield_latest_annual": ["operating_cash_flow", "capital_expenditures", *CAP],
    "earnings_yield_latest_annual": ["net_income", *CAP],
}
INPUTS = sorted({x for own in METRICS.values() for x in own})


def valuation_metrics(wide: DataFrame, keys: list[str], factor: float = 1.0, places: int = 6) -> DataFrame:
    """(keys, metric, value, status, reason) for each metric of each wide row; inputs it has no column for are missing.

    factor: market units in a reported share. A missing input, or D&A for EBITDA, is the first reason; then a price,
    share count or denominator not above zero. One projection, no shuffle.
    """
    full = wide.withColumns({n: F.lit(None).cast("double") for n in INPUTS if n not in wide.columns})
    x = F.col
    cap = x("close_price") * x("shares_outstanding") * F.lit(factor)
    debt = x(DEBT[0]) + x(DEBT[1]) + x(DEBT[2])
    ev = cap + debt - x("cash_and_cash_equivalents")
    over: dict[str, tuple[Column, Column | None]] = {
        "market_cap": (cap, None),
        "financial_debt": (debt, None),
        "enterprise_value": (ev, None),
        "price_to_earnings_latest_annual": (cap, x("net_income")),
        "price_to_book": (cap, x("stockholders_equity")),
        "price_to_sales_latest_annual": (cap, x("revenue")),
        "enterprise_value_to_sales_latest_annual": (ev, x("revenue")),
        "enterprise_value_to_ebit_latest_annual": (ev, x("operating_income")),
        "enterprise_value_to_ebitda_latest_annual": (ev, x("operating_income") + x("depreciation_and_amortization")),
        "free_cash_flow_yield_latest_annual": (x("operating_cash_flow") - x("capital_expenditures"), cap),
        "earnings_yield_latest_annual": (x("net_income"), cap),
    }

    def one(name: str) -> Column:
        missing = F.array_compact(F.array(*[F.when(x(c).isNull(), F.lit(c)) for c in METRICS[name]]))
        top, below = over[name]
        bad = F.lit(False)
        if "close_price" in METRICS[name]:
            bad = (x("close_price") <= 0) | (x("shares_outstanding") <= 0)
        if below is not None:
            bad = bad | (below <= 0)
        reason = F.when(F.array_contains(missing, "depreciation_and_amortization"), "ebitda_unavailable").when(F.size(missing) > 0, "missing_input").when(bad, "invalid_denominator")
        value = F.when(reason.isNull(), F.round(top if below is None else F.try_divide(top, below), places))
        return F.struct(F.lit(name).alias("metric"), value.alias("value"), F.when(reason.isNull(), "evaluated").otherwise("not_evaluable").alias("status"), reason.alias("reason"))

    return full.select(*keys, F.explode(F.array(*[one(n) for n in METRICS])).alias("m")).select(*keys, "m.*")


def valuation_status(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage of each snapshot and what it is worth: evaluated, partial or not_evaluable."""
    n = F.count(F.when(F.col("status") == "evaluated", F.lit(1)))
    out = metrics.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), n.alias("evaluated"))
    return out.withColumn("status", F.when(F.col("evaluated") == F.col("total"), "evaluated").when(F.col("evaluated") > 0, "partial").otherwise("not_evaluable"))


def valuation_history(points: DataFrame, keys: list[str], day: str, known: str, value: str, places: int = 6) -> DataFrame:
    """Statistics of the values of each key over its days; of several values for a day the one known last counts.

    Where values known at the same moment differ, the day is ambiguous: it is counted and takes no part. Days are reduced
    before they move; a key's days are bounded by the calendar. rank: where the last value stands among the earlier ones,
    (less + equal / 2) / n.
    """
    moments = points.where(F.col(value).isNotNull() & F.col(day).isNotNull() & F.col(known).isNotNull()).groupBy(*keys, day, known).agg(F.min(value).alias("__low"), F.max(value).alias("__high"), F.count(F.lit(1)).alias("__n"))
    days = moments.groupBy(*keys, day).agg(F.max(F.struct(known, "__low", "__high")).alias("x"), F.sum("__n").alias("__n"))
    one = days.select(*keys, day, F.col("x.__low").alias("v"), (F.col("x.__low") != F.col("x.__high")).alias("ambiguous"), (F.col("__n") - 1).alias("superseded"))
    fine = F.when(~F.col("ambiguous"), F.struct(day, "v"))
    out = one.groupBy(*keys).agg(
        F.array_sort(F.collect_list(fine)).alias("p"), F.sum(F.col("ambiguous").cast("long")).alias("ambiguous"), F.sum("superseded").alias("superseded"),
    ).where(F.size("p") > 0)
    v = F.transform("p", lambda p: p["v"])
    n, last, first = F.size("p"), F.element_at(v, -1), F.element_at(v, 1)
    earlier = F.slice(v, 1, F.greatest(n - 1, F.lit(1)))
    mid = F.size(F.filter(earlier, lambda a: a < F.element_at(v, -1))) + 0.5 * F.size(F.filter(earlier, lambda a: a == F.element_at(v, -1)))
    r = lambda c: F.round(c, places)
    return out.select(
        *keys, n.cast("long").alias("points"), first.alias("first_value"), last.alias("last_value"), F.array_min(v).alias("least"), F.array_max(v).alias("most"), r(F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / n).alias("mean"),
        r(F.array_max(v) - F.array_min(v)).alias("value_range"), F.when(n > 1, r(last - F.try_element_at(v, F.lit(-2)))).alias("previous_change"), F.when(n > 1, r(last - first)).alias("horizon_change"),
        F.when(n > 1, r(mid / (n - 1))).alias("rank"), "ambiguous", "superseded",
    )


def percentile_rule(history: DataFrame, operator: str, threshold: float, least_points: int = 2) -> DataFrame:
    """history with ``outcome``: 'met' or 'not_met' by the rank of the last value, 'not_evaluable' with too few points."""
    tests = {"at_or_below": F.col("rank") <= threshold, "at_or_above": F.col("rank") >= threshold}
    return history.withColumn("outcome", F.when((F.col("points") < least_points) | F.col("rank").isNull(), "not_evaluable").when(tests[operator], "met").otherwise("not_met"))
