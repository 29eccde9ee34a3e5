"""The 100-point score of every bar, its rating, its context and its gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.config import GATES, Gates
from tickloom.functions import indicators as ind
from tickloom.operators.signals import with_levels


def steps(value: Column, *pairs: tuple[float, int]) -> Column:
    """Points of the first pair (least value, points) that value reaches; 0 below all or for NULL."""
    out = None
    for least, points in pairs:
        out = F.when(value >= least, points) if out is None else out.when(value >= least, points)
    return out.otherwise(0)


def breakout(feat: DataFrame) -> DataFrame:
    """Adds orb_window, orb_dir and orb_strength: the strongest strict break of the 15- or 30-minute range (3 and 6 bars), NULL without one."""
    close = F.col("close")
    found = []
    for minutes, n in ((15, 3), (30, 6)):
        high, low = F.col(f"orb{n}_high"), F.col(f"orb{n}_low")
        for way, broken, strength in (("long", close > high, F.try_divide(close - high, high) * 100), ("short", close < low, F.try_divide(low - close, low) * 100)):
            found.append(F.when(broken, F.struct(strength.alias("strength"), F.lit(-minutes).alias("m"), F.lit(way).alias("dir"))))
    best = F.greatest(*found)
    return feat.withColumn("__b", best).withColumns({"orb_window": -F.col("__b.m"), "orb_dir": F.col("__b.dir"), "orb_strength": F.col("__b.strength")}).drop("__b")


def score(feat: DataFrame) -> DataFrame:
    """Direction by votes of gap, VWAP, means and breakout, and its points, of every bar with rvol and two sessions of history.

    A bar with a tie of votes has direction none and no points.
    """
    c = F.col
    out = breakout(feat).where("session_no >= 2 and bar_no >= 4")
    vote = F.when(c("gap_pct").isNull(), 0).when(c("gap_pct") > 0, 1).otherwise(-1) + F.when(c("close") > c("vwap"), 1).otherwise(-1) + F.when(c("ema20") > c("ema50"), 1).otherwise(-1) + F.when(c("orb_dir") == "long", 1).when(c("orb_dir") == "short", -1).otherwise(0)
    out = out.withColumn("votes", vote).withColumn("direction", F.when(c("votes") > 0, "long").when(c("votes") < 0, "short").otherwise("none"))
    long, some = c("direction") == "long", c("direction") != "none"
    gap = F.coalesce(F.when(long, c("gap_pct")).otherwise(-c("gap_pct")), F.lit(0.0))
    points = {
        "pts_gap": steps(gap, (2, 20), (1.5, 15), (1.0, 10), (0.5, 5)),
        "pts_rvol": steps(c("rvol"), (2, 25), (1.5, 18), (1.2, 10)),
        "pts_vwap": F.when(F.when(long, c("close") > c("vwap")).otherwise(c("close") < c("vwap")), 15).otherwise(0),
        "pts_ema": F.when(F.when(long, c("ema20") > c("ema50")).otherwise(c("ema20") < c("ema50")), 15).otherwise(0),
        "pts_orb": F.when(c("orb_dir") == c("direction"), F.when(c("orb_strength") >= 0.10, 15).otherwise(8)).otherwise(0),
        "pts_vol": steps(c("vol_ratio"), (1.5, 10), (1.2, 5)),
    }
    out = out.withColumns({k: F.when(some, v).otherwise(0) for k, v in points.items()})
    out = out.withColumn("score", sum(c(k) for k in points))
    strong = F.when(long, "Strong Buy").otherwise("Strong Sell")
    out = out.withColumn("rating", F.when(c("score") >= 80, strong).when(c("score") >= 60, "Watchlist").otherwise("Avoid"))
    lean = F.bround(F.least(F.lit(90.0), F.greatest(F.lit(50.0), 45 + c("score") * 0.42))).cast("int")
    bull = F.when(c("direction") == "none", 50).when(long, lean).otherwise(100 - lean)
    return with_levels(out.withColumn("bull_conviction", bull).withColumn("bear_conviction", F.when(some, 100 - bull).otherwise(50)))


def breakdown() -> Column:
    """The points as a map from component to points."""
    names = {"Gap": "pts_gap", "Relative Volume": "pts_rvol", "VWAP": "pts_vwap", "EMA Trend": "pts_ema", "ORB Breakout": "pts_orb", "Volume Breakout": "pts_vol"}
    return F.create_map(*(x for k, v in names.items() for x in (F.lit(k), F.col(v))))


def with_regime(scored: DataFrame, trends: DataFrame) -> DataFrame:
    """Adds regime_ok: false where indices have a trend at the bar's time and none of them goes with the direction.

    trends (ts, trend) has one row for each index and time.
    """
    at = trends.groupBy("ts").agg(F.bool_or(F.col("trend") == "bullish").alias("up"), F.bool_or(F.col("trend") == "bearish").alias("down"))
    ok = F.when(F.col("direction") == "long", F.col("up")).otherwise(F.col("down"))
    return scored.join(at, "ts", "left").withColumn("regime_ok", F.coalesce(ok, F.lit(True))).drop("up", "down")


def with_events(scored: DataFrame, results: DataFrame, within: int = 2) -> DataFrame:
    """Adds days_to_results and event_ok from the next results date (symbol, results_date) of each symbol on or after the session."""
    ahead = scored.select("symbol", "session").distinct().join(results, "symbol").where("results_date >= session")
    ahead = ahead.groupBy("symbol", "session").agg(F.min("results_date").alias("next"))
    out = scored.join(ahead, ["symbol", "session"], "left").withColumn("days_to_results", F.datediff("next", "session")).drop("next")
    return out.withColumn("event_ok", ~F.coalesce(F.col("days_to_results").between(0, within), F.lit(False)))


def with_delivery(scored: DataFrame, delivery: DataFrame, days: int = 5) -> DataFrame:
    """Adds delivery_pct: each symbol's percentage in the newest file (symbol, as_of, delivery_pct) of the days up to the session.

    The newest day with a number of any symbol counts for all, so a symbol that it lacks
    has NULL, though an older day may have one. Sessions asked for meet days by an
    equi-join on the dates that each may use.
    """
    asked = scored.select("session").distinct().withColumn("as_of", F.explode(F.sequence(F.date_sub("session", days), F.col("session"))))
    newest = asked.join(delivery.where("delivery_pct is not null").select("as_of").distinct(), "as_of").groupBy("session").agg(F.max("as_of").alias("as_of"))
    found = newest.join(delivery, "as_of").select("symbol", "session", "delivery_pct")
    return scored.join(found, ["symbol", "session"], "left")


def extremes(days: DataFrame, bars: int = 252, least: int = 30) -> DataFrame:
    """high_52w and low_52w added to daily bars with `least` bars of history."""
    w = ind.last(bars)
    return days.withColumns({"high_52w": F.max("high").over(w), "low_52w": F.min("low").over(w)}).where(F.col("rn") >= least)


def near(within: float = 0.03) -> Column:
    """high, low or NULL: the 52-week extreme that close is within this share of."""
    high = (F.col("high_52w") > 0) & (F.try_divide(F.col("high_52w") - F.col("close"), F.nullif("high_52w", F.lit(0.0))) <= within)
    low = (F.col("low_52w") > 0) & (F.try_divide(F.col("close") - F.col("low_52w"), F.nullif("low_52w", F.lit(0.0))) <= within)
    return F.when(high, "high").when(low, "low")


def near_extremes(days: DataFrame, bars: int = 252, least: int = 30, within: float = 0.03) -> DataFrame:
    """Adds high_52w, low_52w and near (high, low or NULL) to daily bars with `least` bars of history."""
    return extremes(days, bars, least).withColumn("near", near(within))


def of_day_before(rows: DataFrame, days: DataFrame, values: list[str]) -> DataFrame:
    """Adds the values of the symbol's last row of days (symbol, session) before each row's session.

    Rows of both frequencies stand in one order by symbol, a session's own daily row
    after its bars, and each bar takes the last daily row before it; nothing is joined.
    """
    one = rows.select("symbol", "session", F.lit(0).alias("__daily"), F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("__row"), F.lit(None).cast(days.select(F.struct(*values)).schema[0].dataType).alias("__day"))
    two = days.select("symbol", "session", F.lit(1).alias("__daily"), F.lit(None).cast(one.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__day"))
    w = W.partitionBy("symbol").orderBy("session", "__daily").rowsBetween(W.unboundedPreceding, 0)
    out = one.unionByName(two).withColumn("__day", F.last("__day", ignorenulls=True).over(w)).where("__daily = 0")
    return out.select("__row.*", *(F.col(f"__day.{v}").alias(v) for v in values))


def with_index_list(scored: DataFrame, trends: DataFrame) -> DataFrame:
    """Adds index_list, the trends of all indices (symbol, ts, trend) at the bar's time as `name trend` in order of name."""
    listed = trends.groupBy("ts").agg(F.array_join(F.sort_array(F.collect_set(F.concat_ws(" ", "symbol", "trend"))), ", ").alias("index_list"))
    return scored.join(listed, "ts", "left")


def context_notes(scored: DataFrame) -> DataFrame:
    """Adds context and notes arrays from st_dir, index_list, regime_ok, near, delivery_pct and days_to_results where the table has them."""
    has = set(scored.columns)
    long, c = F.col("direction") == "long", F.col
    context, notes = [], []
    if "st_dir" in has:
        context.append(F.when(c("st_dir") == 1, "supertrend bullish").otherwise("supertrend bearish"))
        notes.append(F.when((c("st_dir") == 1) != long, "supertrend against direction"))
    if "index_list" in has:
        context.append(F.when(c("index_list") != "", F.concat(F.lit("index "), c("index_list"))))
    if "regime_ok" in has:
        notes.append(F.when(~c("regime_ok"), "counter-trend"))
    if "near" in has:
        context.append(F.when(c("near").isNotNull(), F.concat(F.lit("near 52-week "), c("near"))))
    if "delivery_pct" in has:
        context.append(F.concat(F.lit("delivery "), F.bround("delivery_pct").cast("int").cast("string"), F.lit("%")))
        context.append(F.when(c("delivery_pct") >= 60, "strong delivery"))
        notes.append(F.when(c("delivery_pct") < 25, "low delivery"))
    if "days_to_results" in has:
        notes.append(F.when(c("days_to_results").between(0, 2), "results near"))
    texts = lambda parts: F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    return scored.withColumns({"context": texts(context), "notes": texts(notes)})


def gate_reason(g: Gates = GATES) -> Column:
    """NULL for a bar that may fire, else low_score, counter_trend or results_near."""
    return F.when(F.col("score") < g.min_score, "low_score").when(~F.col("regime_ok"), "counter_trend").when(~F.col("event_ok"), "results_near")
