"""The feature pass: every indicator of every bar of every symbol, on one exchange by symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions import indicators as ind


def features(bars: DataFrame, carried: bool = False) -> DataFrame:
    """Adds atr14, rsi14, ema9/20/50, vwap, vwap_slope, vol_ratio, swing_low/high, the opening ranges and the gap.

    carried says that bars have their exponential means already.
    """
    out = ind.with_rsi(ind.with_atr(bars))
    out = out if carried else ind.with_emas(out, {"ema9": ("close", 9), "ema20": ("close", 20), "ema50": ("close", 50)})
    session = ind.by_session().rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("prev_close", ind.previous("close")).withColumn("vwap", ind.vwap())
    out = out.withColumns({"vwap_slope": ind.slope_pct("vwap"), "vol_ratio": ind.volume_ratio(), "swing_low": ind.swing_low(), "swing_high": ind.swing_high()})
    for n in (3, 6):
        high, low = ind.opening_range(n)
        out = out.withColumns({f"orb{n}_high": high, f"orb{n}_low": low})
    before, opened = F.first("prev_close").over(session), F.first("open").over(session)
    return out.withColumns({"session_open": opened, "gap_pct": F.try_divide(opened - before, F.nullif(before, F.lit(0.0))) * 100})


def with_relative_volume(bars: DataFrame, sessions: int = 4) -> DataFrame:
    """Adds rvol: volume of the session so far against the mean of the sessions before up to the same bar.

    A shorter session counts whole and one without volume not at all; NULL in a symbol's
    first session. Sessions that have the bar are summed in a window over symbol and bar
    number; of those that ended before it, a list of at most `sessions` ends tells the
    volume. All windows share the exchange by symbol, and nothing is joined.
    """
    session = W.partitionBy("symbol", "session_no")
    out = bars.withColumns({"__so_far": F.sum("volume").over(session.orderBy("bar_no").rowsBetween(W.unboundedPreceding, 0)), "__bars": F.max("bar_no").over(session)})
    end = F.when(F.col("bar_no") == F.col("__bars"), F.struct(F.col("__bars").alias("bars"), F.col("__so_far").alias("total")))
    before, same = W.partitionBy("symbol").orderBy("session_no").rangeBetween(-sessions, -1), W.partitionBy("symbol", "bar_no").orderBy("session_no").rangeBetween(-sessions, -1)
    traded = F.when(F.col("__so_far") > 0, F.col("__so_far"))
    out = out.withColumns({"__ends": F.collect_list(end).over(before), "__sum": F.coalesce(F.sum(traded).over(same), F.lit(0.0)), "__n": F.count(traded).over(same)})
    short = F.transform(F.filter("__ends", lambda x: (x["bars"] < F.col("bar_no")) & (x["total"] > 0)), lambda x: x["total"])
    mean = F.try_divide(F.col("__sum") + F.aggregate(short, F.lit(0.0), lambda a, x: a + x), F.col("__n") + F.size(short))
    return out.withColumn("rvol", F.when(mean > 0, F.try_divide(F.col("__so_far"), mean))).drop("__so_far", "__bars", "__ends", "__sum", "__n")


def relative_volume(bars: DataFrame, sessions: int = 4) -> DataFrame:
    """(symbol, session_no, bar_no, rvol) of every bar after its symbol's first session."""
    return with_relative_volume(bars, sessions).where("session_no > 1").select("symbol", "session_no", "bar_no", "rvol")


def index_trend(feat: DataFrame) -> DataFrame:
    """trend of each bar with three bars in its session: bullish above VWAP and EMA 20, bearish below both, else flat."""
    up, down = (F.col("close") > F.col("vwap")) & (F.col("close") > F.col("ema20")), (F.col("close") < F.col("vwap")) & (F.col("close") < F.col("ema20"))
    return feat.where("bar_no >= 3").select("symbol", "session", "ts", F.when(up, "bullish").when(down, "bearish").otherwise("flat").alias("trend"))


def snapshot(bars: DataFrame) -> DataFrame:
    """Last close, the one before, the change, and the session's high and low, of symbols with two bars."""
    w = ind.by_session().rowsBetween(W.unboundedPreceding, 0)
    out = bars.withColumns({"prev": ind.previous("close"), "day_high": F.max("high").over(w), "day_low": F.min("low").over(w)})
    out = ind.latest(out).where("prev is not null")
    return out.select("symbol", F.col("close").alias("last"), "prev", (F.col("close") - F.col("prev")).alias("change"), (F.try_divide(F.col("close") - F.col("prev"), F.nullif("prev", F.lit(0.0))) * 100).alias("change_pct"), "day_high", "day_low")
