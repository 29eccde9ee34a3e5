"""Indicators as columns over windows. A value that lacks history is NULL, never NaN."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F


def by_symbol() -> WindowSpec:
    return W.partitionBy("symbol").orderBy("session", "ts")


def by_session() -> WindowSpec:
    return W.partitionBy("symbol", "session").orderBy("ts")


def last(n: int, until: int = 0) -> WindowSpec:
    """The n bars of the symbol that end `until` bars before this one."""
    return by_symbol().rowsBetween(-(n - 1) - until, -until)


def full(value: Column, of: Column, n: int, w: WindowSpec) -> Column:
    """value where the window holds n values of `of`."""
    return F.when(F.count(of).over(w) == n, value)


def sma(c: str, n: int) -> Column:
    return full(F.avg(c).over(last(n)), F.col(c), n, last(n))


def bollinger(c: str, n: int = 20, k: float = 2.0) -> tuple[Column, Column, Column]:
    """Upper band, middle and lower band; the deviation is that of a sample."""
    mid, dev = sma(c, n), full(F.stddev_samp(c).over(last(n)), F.col(c), n, last(n))
    return mid + k * dev, mid, mid - k * dev


def previous(c: str) -> Column:
    return F.lag(c).over(by_symbol())


def true_range() -> Column:
    """greatest() passes over the first bar's missing close."""
    p = previous("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - p), F.abs(F.col("low") - p))


def with_atr(bars: DataFrame, n: int = 14, into: str = "atr14") -> DataFrame:
    return bars.withColumn("tr", true_range()).withColumn(into, sma("tr", n))


def with_rsi(bars: DataFrame, n: int = 14, into: str = "rsi14") -> DataFrame:
    """Plain-mean RSI; the first bar counts as no change, gains without losses are 100, no change at all is NULL."""
    d = F.coalesce(F.col("close") - previous("close"), F.lit(0.0))
    out = bars.withColumn("__up", F.greatest(d, F.lit(0.0))).withColumn("__down", F.greatest(-d, F.lit(0.0)))
    up, down = F.avg("__up").over(last(n)), F.avg("__down").over(last(n))
    rsi = F.when(F.count("close").over(last(n)) < n, None).when(down > 0, 100 - 100 / (1 + F.try_divide(up, down))).when(up > 0, 100.0)
    return out.withColumn(into, rsi).drop("__up", "__down")


def with_emas(bars: DataFrame, emas: dict[str, tuple[str, int]], step: str = "rn") -> DataFrame:
    """Exponential means {name: (column, span)} that start at the first bar.

    The recursion y = (1 - a) y' + a x becomes sums inside blocks of B bars, scaled by
    powers of q = 1 - a, plus what the block before ended with. B is so long that what
    stood before that block weighs under 1e-17, so a mean is exact to rounding in window
    functions alone: no join, no collected history, the same exchange as other indicators.
    step numbers a symbol's bars from 1, the one the means start at; bars before it have
    numbers below 1 and no means.
    """
    decay = [1 - 2 / (span + 1) for _, span in emas.values()]
    size = max(math.ceil(40 / -math.log(q)) for q in decay if q > 0)
    if any(q > 0 and -size * math.log(q) > 690 for q in decay):
        half = sorted(emas, key=lambda k: emas[k][1])
        cut = len(half) // 2
        first = with_emas(bars, {k: emas[k] for k in half[:cut]}, step)
        return with_emas(first, {k: emas[k] for k in half[cut:]}, step)
    row = F.col(step) - 1
    out = bars.withColumn("__blk", F.floor(row / size)).withColumn("__off", (row % size).cast("double"))
    inside = W.partitionBy("symbol", "__blk").orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    before = by_symbol().rowsBetween(W.unboundedPreceding, -1)
    for (name, (c, span)), q in zip(emas.items(), decay, strict=True):
        if q <= 0:
            out = out.withColumn(name, F.col(c))
            continue
        weight = F.when(F.col(step) == 1, 1.0).otherwise(1 - q)
        out = out.withColumn(f"__{name}", F.sum(weight * F.col(c) * F.pow(F.lit(1 / q), F.col("__off"))).over(inside) * F.pow(F.lit(q), F.col("__off")))
    for name, q in zip(emas, decay, strict=True):
        if q > 0:
            end = F.last(F.when(F.col("__off") == size - 1, F.col(f"__{name}")), ignorenulls=True).over(before)
            out = out.withColumn(name, F.col(f"__{name}") + F.coalesce(end, F.lit(0.0)) * F.pow(F.lit(q), F.col("__off") + 1))
    return out.drop("__blk", "__off", *(f"__{n}" for n in emas))


def with_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    out = with_emas(bars, {"__fast": ("close", fast), "__slow": ("close", slow)}).withColumn("macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    return with_emas(out, {"macd_signal": ("macd", signal)}).withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def vwap() -> Column:
    """Volume-weighted typical price of the session so far."""
    w = by_session().rowsBetween(W.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return F.try_divide(F.sum(typical * F.col("volume")).over(w), F.nullif(F.sum("volume").over(w), F.lit(0.0)))


def slope_pct(c: str, n: int = 6) -> Column:
    """Least-squares slope of the last n values for each bar, in per cent of their mean."""
    w = last(n)
    slope = F.regr_slope(F.col(c), F.col("rn").cast("double")).over(w)
    return full(F.try_divide(slope, F.nullif(F.avg(c).over(w), F.lit(0.0))) * 100, F.col(c), n, w)


def volume_ratio(n: int = 12) -> Column:
    """Volume against the mean of the n bars before; NULL without n bars or where they traded nothing."""
    mean = F.avg("volume").over(last(n, 1))
    return F.when((F.col("rn") > n) & (mean > 0), F.try_divide(F.col("volume"), mean))


def swing_low(n: int = 5) -> Column:
    """Lowest low of the n bars before this one; of all bars where there are no n before."""
    return F.when(F.col("rn") > n, F.min("low").over(last(n, 1))).otherwise(F.min("low").over(by_symbol().rowsBetween(W.unboundedPreceding, 0)))


def swing_high(n: int = 5) -> Column:
    return F.when(F.col("rn") > n, F.max("high").over(last(n, 1))).otherwise(F.max("high").over(by_symbol().rowsBetween(W.unboundedPreceding, 0)))


def opening_range(n: int) -> tuple[Column, Column]:
    """High and low of the session's first n bars, from the bar after them on."""
    w = W.partitionBy("symbol", "session").orderBy("ts").rowsBetween(W.unboundedPreceding, 0)
    beyond, early = F.col("bar_no") > n, F.col("bar_no") <= n
    return F.when(beyond, F.max(F.when(early, F.col("high"))).over(w)), F.when(beyond, F.min(F.when(early, F.col("low"))).over(w))


def crossover(a: str, b: str) -> Column:
    """1 where a has just crossed above b, -1 below, else 0."""
    pa, pb = previous(a), previous(b)
    return F.when((F.col(a) > F.col(b)) & (pa <= pb), 1).when((F.col(a) < F.col(b)) & (pa >= pb), -1).otherwise(0)


def latest(bars: DataFrame) -> DataFrame:
    """The last bar of each symbol, with all columns: the one that none follows, in the order in which the indicators have sorted the bars already."""
    return bars.withColumn("__follows", F.lead(F.lit(True)).over(by_symbol())).where("__follows is null").drop("__follows")
