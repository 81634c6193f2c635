"""Indicators of bar series, by row frames (``ordered``): nothing is filled, a missing input gives no row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitspark.operators.ordered import decayed_sums, frame, rolling


def simple_return(bars: DataFrame, keys: list[str]) -> DataFrame:
    prev = F.lag("close").over(frame(keys))
    return rolling(bars, keys, 1, {"ret": F.try_divide(F.col("close"), prev) - 1})


def sma(bars: DataFrame, keys: list[str], n: int) -> DataFrame:
    return rolling(bars, keys, n - 1, {"sma": F.avg("close").over(frame(keys, -(n - 1)))}).where(F.col("rn") >= n - 1)


def volatility(bars: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Sample deviation of the last n returns, from the (n+1)th row."""
    returns = simple_return(bars, keys)
    return rolling(returns, keys, n - 1, {"volatility": F.stddev_samp("ret").over(frame(keys, -(n - 1)))}).where(F.col("rn") >= n)


def relative_volume(bars: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Volume over the mean of the n rows before it; no row where that is zero."""
    base = rolling(bars, keys, n, {"base": F.avg("volume").over(frame(keys, -n, -1))}).where((F.col("rn") >= n) & (F.col("base") != 0))
    return base.withColumn("relative_volume", F.col("volume") / F.col("base"))


def bollinger(bars: DataFrame, keys: list[str], n: int, width: float, flat_rows: bool = False) -> DataFrame:
    """Bands around the mean of n closes; percent_b of a flat band is null, and its row left out unless flat_rows."""
    w = frame(keys, -(n - 1))
    out = rolling(bars, keys, n - 1, {"middle": F.avg("close").over(w), "__dev": F.stddev_pop("close").over(w)}).where(F.col("rn") >= n - 1)
    out = out.withColumns({"upper": F.col("middle") + width * F.col("__dev"), "lower": F.col("middle") - width * F.col("__dev")})
    out = out.withColumns(
        {
            "bandwidth": F.try_divide(F.col("upper") - F.col("lower"), F.col("middle")),
            "percent_b": F.when(F.col("__dev") > 1e-12 * F.abs("middle"), F.try_divide(F.col("close") - F.col("lower"), F.col("upper") - F.col("lower"))),
        }
    ).drop("__dev")
    return out if flat_rows else out.where("percent_b is not null")


def true_range(bars: DataFrame, keys: list[str]) -> DataFrame:
    prev = F.lag("close").over(frame(keys))
    return rolling(bars, keys, 1, {"true_range": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))})


def _smoothed(rows: DataFrame, keys: list[str], means: list[tuple[str, str, int, float]]) -> DataFrame:
    """For each (value, out, n, weight) the recursive mean ``out``: at row n-1 the plain mean of the first n values, then
    each value with ``weight``. Rows begin where all of them do."""
    seeds = {f"__seed{k}": F.avg(value).over(frame(keys, -(n - 1))) for k, (value, _, n, _) in enumerate(means)}
    seeded = rolling(rows, keys, max(n for *_, n, _ in means) - 1, seeds)
    adds = {f"__add{k}": F.when(F.col("rn") == n - 1, F.col(f"__seed{k}")).when(F.col("rn") >= n, F.lit(weight) * F.col(value)) for k, (value, _, n, weight) in enumerate(means)}
    summed = decayed_sums(seeded.withColumns(adds), keys, [(f"__add{k}", out, 1 - weight) for k, (_, out, _, weight) in enumerate(means)])
    return summed.where(F.col("rn") >= max(n for *_, n, _ in means) - 1).drop(*seeds, *adds)


def ema(bars: DataFrame, keys: list[str], n: int, value: str = "close", out: str = "ema") -> DataFrame:
    """Exponential mean with weight 2/(n+1), seeded by the first n values."""
    return _smoothed(bars, keys, [(value, out, n, 2 / (n + 1))])


def rsi(bars: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Relative strength by Wilder's smoothing of gains and losses: 50 without either, 100 without losses, 0 without gains."""
    moves = rolling(bars, keys, 1, {"__change": F.col("close") - F.lag("close").over(frame(keys))}).where("rn >= 1")
    moves = moves.withColumns({"__gain": F.greatest("__change", F.lit(0.0)), "__loss": F.greatest(-F.col("__change"), F.lit(0.0)), "rn": F.col("rn") - 1})
    both = _smoothed(moves, keys, [("__gain", "average_gain", n, 1 / n), ("__loss", "average_loss", n, 1 / n)])
    total = F.col("average_gain") + F.col("average_loss")
    return both.withColumns({"rsi": F.when(total == 0, F.lit(50.0)).otherwise(100 * F.try_divide(F.col("average_gain"), total)), "rn": F.col("rn") + 1}).drop("__change", "__gain", "__loss")


def atr(bars: DataFrame, keys: list[str], n: int) -> DataFrame:
    return _smoothed(true_range(bars, keys), keys, [("true_range", "atr", n, 1 / n)])


def macd(bars: DataFrame, keys: list[str], fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Line, signal and histogram; rows begin where the signal does."""
    if fast >= slow:
        raise ValueError("fast must be below slow")
    both = _smoothed(bars, keys, [("close", "ema_fast", fast, 2 / (fast + 1)), ("close", "ema_slow", slow, 2 / (slow + 1))])
    line = both.withColumns({"line": F.col("ema_fast") - F.col("ema_slow"), "rn": F.col("rn") - (slow - 1)})
    out = ema(line, keys, signal, value="line", out="signal")
    return out.withColumns({"histogram": F.col("line") - F.col("signal"), "rn": F.col("rn") + (slow - 1)})


def gap_free_sum(points: DataFrame, keys: list[str], n: int, value: str, cell: str) -> DataFrame:
    """Sum and mean over n consecutive cells; a gap among them gives no row. Points must be unique in ``cell``."""
    w = frame(keys)
    out = rolling(points, keys, n - 1, {"__from": F.lag(cell, n - 1).over(w), "total": F.sum(value).over(frame(keys, -(n - 1)))})
    return out.where(F.col(cell) - F.col("__from") == n - 1).withColumn("mean", F.col("total") / n).drop("__from") if n > 1 else out.withColumn("mean", F.col("total")).drop("__from")


def lagged_change(points: DataFrame, keys: list[str], k: int, value: str, cell: str) -> DataFrame:
    """Change over k cells, only where all k + 1 of them are there."""
    w = frame(keys)
    out = rolling(points, keys, k, {"__from": F.lag(cell, k).over(w), "__was": F.lag(value, k).over(w)})
    return out.where(F.col(cell) - F.col("__from") == k).withColumn("change", F.col(value) - F.col("__was")).drop("__from", "__was")


def drawdown(bars: DataFrame, keys: list[str], block: int = 0) -> DataFrame:
    """Running peak of the close, and the fall from it; peaks of earlier parts come from one row a part."""
    from pyspark.sql import Window

    from pitspark.operators.ordered import PART

    cut = bars.withColumn("__part", F.floor(F.col("rn") / F.lit(float(block or PART))).cast("long"))
    tops = cut.groupBy(*keys, "__part").agg(F.max("close").alias("__top"))
    earlier = tops.select(*keys, "__part", F.max("__top").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    own = F.max("close").over(Window.partitionBy(*keys, "__part").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0))
    out = cut.withColumn("__own", own).join(earlier, [*keys, "__part"]).withColumn("peak", F.greatest("__own", "__before"))
    return out.withColumn("drawdown", F.col("close") / F.col("peak") - 1).drop("__part", "__own", "__before")
