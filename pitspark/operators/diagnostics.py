"""Readings of a market and of a company as scores between 0 and 100, with confidence, and what is missing for one.

The bounds and weights are fixed values of the published rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.functions.scalars import clamp

QUALITY_CAPS = {"valid": 1.0, "delayed": 0.9, "partial": 0.75, "suspect": 0.5}
#: Metric, weight, value that scores 0, value that scores 100.
FUNDAMENTAL = [
    ("net_margin", 0.30, 0.0, 0.25),
    ("liabilities_to_assets", 0.25, 0.90, 0.40),
    ("liabilities_to_equity", 0.15, 5.0, 0.50),
    ("revenue_yoy_growth", 0.15, -0.10, 0.15),
    ("net_income_yoy_change_rate", 0.15, -0.50, 0.50),
]
NEEDED, LEAST_COVERAGE = ["net_margin", "liabilities_to_assets"], 0.60
#: Days up to which a filing is fresh, and from which it is stale.
FRESH = {"quarterly": (150, 365), "annual": (400, 800)}


def verdict(score: Column, positive: float = 60.0, negative: float = 40.0, strict: bool = False) -> Column:
    """strict: a score at the lower bound is still neutral."""
    low = score < negative if strict else score <= negative
    return F.when(score >= positive, "positive").when(low, "negative").otherwise("neutral")


def market_reading(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """From rows with short, long (means), ret, volatility, relative_volume and quality: trend, momentum, score, verdict,
    confidence, the signals, and what is missing. A row that misses a metric gives no reading but 'insufficient_data'."""
    names = ["short", "long", "ret", "volatility", "relative_volume"]
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    spread = F.try_divide(F.col("short"), F.col("long")) - 1
    trend, momentum = clamp(50 + 1000 * spread, 0.0, 100.0), clamp(50 + 1000 * F.col("ret"), 0.0, 100.0)
    score = 0.6 * trend + 0.4 * momentum
    cap = F.lit(0.75)
    for name, most in QUALITY_CAPS.items():
        cap = F.when(F.col("quality") == name, F.lit(most)).otherwise(cap)
    confidence = F.least((clamp(F.col("relative_volume") / 2, 0.0, 1.0) + clamp(1 - F.col("volatility") / 0.10, 0.0, 1.0)) / 2, cap)
    whole = F.size(missing) == 0
    r = lambda c: F.round(c, 4)
    return metrics.select(
        *keys, F.when(whole, r(trend)).alias("trend"), F.when(whole, r(momentum)).alias("momentum"), F.when(whole, r(score)).otherwise(0.0).alias("score"),
        F.when(whole, verdict(F.round(score, 9))).otherwise("insufficient_data").alias("verdict"), F.when(whole, r(confidence)).otherwise(0.0).alias("confidence"),
        F.when(whole, r(clamp(spread / 0.05, -1.0, 1.0))).alias("trend_signal"), F.when(whole, r(clamp(F.col("ret") / 0.05, -1.0, 1.0))).alias("momentum_signal"),
        F.coalesce("quality", F.lit("partial")).alias("quality"), F.array_join(missing, ",").alias("missing"),
    )


def fundamental_reading(metrics: DataFrame, keys: list[str], frequency: str, age_days: str) -> DataFrame:
    """From rows with the metrics of FUNDAMENTAL (null where missing), the frequency and the age of the newest input: score by
    weights renormalised over what is there, coverage, recency, confidence, quality and verdict."""
    total, coverage = F.lit(0.0), F.lit(0.0)
    for name, weight, zero, full in FUNDAMENTAL:
        x = F.col(name)
        own = clamp((x - zero) / (full - zero) * 100, 0.0, 100.0)
        total = total + F.coalesce(own * weight, F.lit(0.0))
        coverage = coverage + F.when(x.isNull(), 0.0).otherwise(weight)
    coverage = F.round(coverage, 9)
    there = F.lit(True)
    for name in NEEDED:
        there = there & F.col(name).isNotNull()
    enough = there & (coverage >= LEAST_COVERAGE)
    recency = F.lit(None).cast("double")
    for name, (fresh, stale) in FRESH.items():
        recency = F.when(F.col(frequency) == name, 1 - 0.5 * clamp((F.col(age_days) - fresh) / F.lit(float(stale - fresh)), 0.0, 1.0)).otherwise(recency)
    score = F.round(F.try_divide(total, coverage), 6)
    r = lambda c: F.round(c, 4)
    return metrics.select(
        *keys, F.when(enough, r(score)).otherwise(0.0).alias("score"), r(coverage).alias("coverage"), r(recency).alias("recency"), F.when(enough, r(coverage * recency)).otherwise(0.0).alias("confidence"),
        F.when(enough, verdict(score, 65.0, 40.0, strict=True)).otherwise("insufficient_data").alias("verdict"),
        F.when(enough & (coverage == 1) & (recency >= 0.75), "valid").otherwise("partial").alias("quality"),
    )


def growth_class(eps: Column, revenue: Column) -> Column:
    """Slow grower, stalwart or fast grower by the yearly growth of earnings and revenue a share; null where neither fits."""
    return (
        F.when((eps >= 0) & (eps < 0.10) & (revenue >= 0) & (revenue < 0.10), "slow_grower")
        .when((eps >= 0.10) & (eps < 0.20) & (revenue >= 0.05) & (revenue < 0.20), "stalwart")
        .when((eps >= 0.20) & (revenue >= 0.10), "fast_grower")
    )
