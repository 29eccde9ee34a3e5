"""Signals of every bar: the four-indicator vote with its trade plan, canonical levels, and the opening-range breakout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.config import SWING, Mode
from tickloom.functions import indicators as ind


def vote(bars: DataFrame, mode: Mode = SWING) -> DataFrame:
    """Votes of moving averages, RSI, MACD and Bollinger bands on every bar with enough history; the leading side needs two.

    Confidence is the side's share of the four votes, 50 for HOLD. An unknown RSI holds.
    """
    out = bars.withColumns({"sma_short": ind.sma("close", mode.sma_short), "sma_long": ind.sma("close", mode.sma_long)})
    upper, _, lower = ind.bollinger("close", mode.bollinger)
    out = out.withColumns({"bb_upper": upper, "bb_lower": lower, "sma_cross": ind.crossover("sma_short", "sma_long")})
    out = ind.with_macd(ind.with_atr(ind.with_rsi(out, mode.rsi, "rsi"), mode.rsi, "atr"), *mode.macd)
    session = ind.by_session().rowsBetween(W.unboundedPreceding, 0)
    base = F.first("open").over(session) if mode.from_open else ind.previous("close")
    recent = ind.last(mode.recent)
    out = out.withColumns({"macd_cross": ind.crossover("macd", "macd_signal"), "base": base, "recent_high": F.max("high").over(recent), "recent_low": F.min("low").over(recent)})
    out = out.where(F.col("rn") >= mode.sma_long + 2).withColumn("change_pct", F.try_divide(F.col("close") - F.col("base"), F.nullif("base", F.lit(0.0))) * 100)
    yes = lambda c: F.coalesce(c, F.lit(False))
    votes = {
        "vote_sma": F.when(yes(F.col("sma_short") > F.col("sma_long")), "BUY").otherwise("SELL"),
        "vote_rsi": F.when(yes(F.col("rsi") < 30), "BUY").when(yes(F.col("rsi") > 70), "SELL").otherwise("HOLD"),
        "vote_macd": F.when(F.col("macd_cross") == 1, "BUY").when(F.col("macd_cross") == -1, "SELL").when(yes(F.col("macd_hist") > 0), "BUY").otherwise("SELL"),
        "vote_bb": F.when(yes(F.col("close") < F.col("bb_lower")), "BUY").when(yes(F.col("close") > F.col("bb_upper")), "SELL").otherwise("HOLD"),
    }
    out = out.withColumns(votes)
    count = lambda side: sum((F.col(v) == side).cast("int") for v in votes)
    out = out.withColumns({"buys": count("BUY"), "sells": count("SELL")})
    signal = F.when((F.col("buys") > F.col("sells")) & (F.col("buys") >= 2), "BUY").when((F.col("sells") > F.col("buys")) & (F.col("sells") >= 2), "SELL").otherwise("HOLD")
    out = out.withColumn("signal", signal)
    return out.withColumn("confidence", F.when(F.col("signal") == "HOLD", 50.0).otherwise(F.greatest("buys", "sells") / 4 * 100))


def indicator_list() -> Column:
    """The votes as an array of (name, vote, reason)."""
    name = F.when(F.col("sma_cross") != 0, "SMA Crossover").otherwise("SMA Trend")
    rows = [(name, "vote_sma", F.when(F.col("vote_sma") == "BUY", "short mean above long").otherwise("short mean below long")), (F.lit("RSI"), "vote_rsi", F.concat(F.lit("RSI "), F.coalesce(F.round("rsi", 1).cast("string"), F.lit("n/a")))), (F.lit("MACD"), "vote_macd", F.when(F.col("macd_cross") != 0, "crossover").otherwise("momentum")), (F.lit("Bollinger"), "vote_bb", F.when(F.col("vote_bb") == "HOLD", "within bands").otherwise("outside a band"))]
    return F.array(*(F.struct(n.alias("name"), F.col(v).alias("vote"), r.alias("reason")) for n, v, r in rows))


def trade_plan(voted: DataFrame, mode: Mode = SWING) -> DataFrame:
    """Stop, targets and risk of BUY and SELL bars, and breakout levels of HOLD bars, as columns that are NULL for the others."""
    buy, sell = F.col("signal") == "BUY", F.col("signal") == "SELL"
    hold = F.col("signal") == "HOLD"
    stop = F.when(buy, F.greatest(F.col("close") - F.col("atr") * mode.atr_multiple, F.col("recent_low") * 0.995)).when(sell, F.least(F.col("close") + F.col("atr") * mode.atr_multiple, F.col("recent_high") * 1.005))
    out = voted.withColumns({"entry": F.when(~hold, F.col("close")), "stop_loss": stop, "side": F.when(buy, 1).when(sell, -1)})
    out = out.withColumn("risk", F.col("side") * (F.col("entry") - F.col("stop_loss")))
    out = out.withColumns({"target1": F.col("entry") + F.col("side") * F.col("risk") * 1.5, "target2": F.col("entry") + F.col("side") * F.col("risk") * 3.0, "risk_pct": F.try_divide(F.col("risk"), F.col("entry")) * 100})
    level = F.when(F.col("risk_pct") < 1.5, "Low").when(F.col("risk_pct") < 3.5, "Medium").when(F.col("risk_pct").isNotNull(), "High")
    watch = {"buy_breakout": ("recent_high", 1.002), "buy_breakout_sl": ("recent_high", 0.99), "sell_breakdown": ("recent_low", 0.998), "sell_breakdown_sl": ("recent_low", 1.01)}
    return out.withColumns({"risk_level": level, **{k: F.when(hold, F.col(c) * f) for k, (c, f) in watch.items()}}).drop("side")


def with_levels(rows: DataFrame, entry: str = "close", direction: str = "direction") -> DataFrame:
    """Adds entry, stop_loss, target1 and target2: risk is 1.5 ATR, or 1 % of the entry without one; targets lie 2 and 3 risks away."""
    atr = F.when(F.col("atr14") > 0, F.col("atr14") * 1.5)
    side = F.when(F.col(direction) == "long", 1.0).when(F.col(direction) == "short", -1.0)
    out = rows.withColumn("entry", F.col(entry)).withColumn("__risk", side * F.coalesce(atr, F.col("entry") * 0.01))
    return out.withColumns({"stop_loss": F.col("entry") - F.col("__risk"), "target1": F.col("entry") + 2 * F.col("__risk"), "target2": F.col("entry") + 3 * F.col("__risk")}).drop("__risk")


def signal_metrics(rows: DataFrame) -> DataFrame:
    """Adds risk, reward to risk of both targets, and the stop's distance in per cent."""
    risk = F.abs(F.col("entry") - F.col("stop_loss"))
    ratio = lambda t: F.try_divide(F.abs(F.col(t) - F.col("entry")), F.nullif(risk, F.lit(0.0)))
    return rows.withColumns({"risk": risk, "rr1": ratio("target1"), "rr2": ratio("target2"), "sl_pct": F.try_divide(risk, F.nullif("entry", F.lit(0.0))) * 100})


def setup_a(feat: DataFrame, most_range: float = 0.012) -> DataFrame:
    """Bars that close outside a narrow opening range with VWAP, the short means and RSI all on the same side."""
    close, high, low = F.col("close"), F.col("orb3_high"), F.col("orb3_low")
    narrow = (F.col("bar_no") >= 4) & (F.try_divide(high - low, low) <= most_range)
    out = feat.withColumn("direction", F.when(narrow & (close > high), "long").when(narrow & (close < low), "short")).where("direction is not null")
    long = F.col("direction") == "long"
    checks = [(F.when(long, close > F.col("vwap")).otherwise(close < F.col("vwap")), "vwap"), (F.when(long, F.col("ema9") > F.col("ema20")).otherwise(F.col("ema9") < F.col("ema20")), "ema"), (F.when(long, F.col("rsi14").between(55, 70)).otherwise(F.col("rsi14").between(30, 45)), "rsi")]
    out = out.withColumn("confluences", F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in checks)))).where(F.size("confluences") >= 3)
    return with_levels(out.withColumn("setup", F.lit("A")))


#: Detectors of signals: each takes the feature table and returns the bars that it finds, with direction, setup and levels.
DETECTORS: dict[str, Callable[[DataFrame], DataFrame]] = {"A": setup_a}


def scan_status(feat: DataFrame, rejected: Column, least_bars: int = 30) -> DataFrame:
    """One row for each symbol's last bar: insufficient data, skip with the long gates' code, signal, or no_setup."""
    last = ind.latest(feat.withColumn("code", rejected))
    found = setup_a(last).select("symbol", F.col("direction").alias("found"))
    status = F.when(F.col("rn") < least_bars, "insufficient").when(F.col("code").isNotNull(), "skip").when(F.col("found").isNotNull(), "signal").otherwise("no_setup")
    out = last.join(found, "symbol", "left").withColumn("status", status)
    return out.select("symbol", "session", "ts", "close", "status", F.when(F.col("status") == "skip", F.col("code")).alias("reason"), F.when(F.col("status") == "signal", F.col("found")).alias("direction"))
