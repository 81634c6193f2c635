"""Series held against each other over the moments they share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.operators.indicators import drawdown, simple_return
from pitspark.operators.ordered import frame, index_rows, rolling

#: Variances below this count as none.
NO_VARIANCE = 1e-18


def aligned(series: DataFrame, entity: str, at: str, value: str, names: list[str]) -> DataFrame:
    """One row for each moment at which all named series have a value, with a column for each."""
    cells = [F.max(F.when(F.col(entity) == n, F.col(value))).alias(n) for n in names]
    there = series.where(F.col(entity).isin(names) & F.col(value).isNotNull()).groupBy(at).agg(F.count_distinct(entity).alias("__n"), *cells)
    return there.where(F.col("__n") == len(names)).drop("__n")


def pair_statistics(series: DataFrame, entity: str, day: str, value: str, benchmark: str) -> DataFrame:
    """Each series against the benchmark over their common days: returns, covariance, correlation and beta.

    ``status`` says why a figure is missing: fewer than two returns, or a series without variance.
    """
    b = series.where(F.col(entity) == benchmark).select(F.col(day).alias("__day"), F.col(value).alias("bc"))
    common = series.where(F.col(entity) != benchmark).join(b, F.col(day) == F.col("__day"))
    rows = index_rows(common.select(entity, F.datediff(day, F.lit("1970-01-01").cast("date")).alias("day"), F.col(value).alias("pc"), "bc"), [entity], "day", 365)
    prev = lambda c: F.lag(c).over(frame([entity]))
    r = rolling(rows, [entity], 1, {"pr": F.try_divide(F.col("pc"), prev("pc")) - 1, "br": F.try_divide(F.col("bc"), prev("bc")) - 1})
    few, vp, vb = F.count("pr") < 2, F.var_samp("pr"), F.var_samp("br")
    fine = ~few & (vp >= NO_VARIANCE) & (vb >= NO_VARIANCE)
    rounded = lambda c, n=6: F.round(c, n)
    ratio: Column = F.try_divide(F.covar_samp("pr", "br"), F.stddev_samp("pr") * F.stddev_samp("br"))
    return r.groupBy(entity).agg(
        F.count(F.lit(1)).alias("days"),
        rounded(F.try_divide(F.max_by("pc", "day"), F.min_by("pc", "day")) - 1).alias("total_return"),
        rounded(F.stddev_samp("pr")).alias("volatility"),
        rounded(F.covar_samp("pr", "br"), 8).alias("covariance"),
        F.when(few, "too_few").when((vp < NO_VARIANCE) | (vb < NO_VARIANCE), "no_variance").otherwise("ok").alias("status"),
        F.when(fine, rounded(ratio)).alias("correlation"),
        F.when(~few & (vb >= NO_VARIANCE), rounded(F.try_divide(F.covar_samp("pr", "br"), vb))).alias("beta"),
    )


def range_statistics(bars: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Extremes, total return and deepest fall of each series."""
    fallen = drawdown(bars, keys)
    return fallen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.round(F.try_divide(F.max_by("close", at), F.min_by("close", at)) - 1, 6).alias("total_return"),
        F.round(F.min("drawdown"), 6).alias("max_drawdown"),
    )


__all__ = ["aligned", "pair_statistics", "range_statistics", "simple_return"]
