"""Outcomes of alerts: which of stop, targets, entry and time each alert's later bars touch first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.config import FAIL, INTRADAY_CATEGORIES, PASS, SWING_CATEGORIES
from tickloom.sources.shared import saved


def normal_direction(c: Column) -> Column:
    """long or short, also from BUY and SELL."""
    up = F.upper(c)
    return F.when(up.isin("BUY", "LONG"), "long").when(up.isin("SELL", "SHORT"), "short")


def pnl_pct(entry: Column, exit_: Column, direction: Column) -> Column:
    return F.when(direction == "long", 1.0).otherwise(-1.0) * F.try_divide(exit_ - entry, F.nullif(entry, F.lit(0.0))) * 100


def status_class(status: Column) -> Column:
    return F.when(status.isin(*PASS), "pass").when(status.isin(*FAIL), "fail").otherwise("neutral")


def _over(bar: Column, level: Column) -> Column:
    """Whether a bar reaches a level in the direction of profit."""
    return F.when(F.col("direction") == "long", bar["high"] >= level).otherwise(bar["low"] <= level)


def _under(bar: Column, level: Column) -> Column:
    """Whether a bar reaches a level against it."""
    return F.when(F.col("direction") == "long", bar["low"] <= level).otherwise(bar["high"] >= level)


def _first_event(bars: Column, inside: Callable[[Column], Column], time_stop: str | None) -> Column:
    """(ts, event, close) of the first of ordered bars that ends a trade or reaches its first target; NULL without one.

    On one bar a time stop comes before the stop, the stop before the first target, and
    the second target after it.
    """
    late = lambda b: F.lit(False) if time_stop is None else b["ts"] > F.col("generated_at") + F.expr(f"interval {time_stop}")
    b = F.get(F.filter(bars, lambda b: inside(b) & (late(b) | _under(b, F.col("stop_loss")) | _over(b, F.col("target1")))), F.lit(0))
    event = F.when(late(b), "time_stop").when(_under(b, F.col("stop_loss")), "sl_hit").when(_over(b, F.col("target2")), "t2_hit").otherwise("t1")
    return F.when(b.isNotNull(), F.struct(b["ts"].alias("ts"), event.alias("event"), b["close"].alias("close")))


def _second_event(bars: Column, inside: Callable[[Column], Column]) -> Column:
    """(ts, event) of the first bar after the first target's that reaches the second target or comes back to the entry."""
    b = F.get(F.filter(bars, lambda b: inside(b) & (b["ts"] > F.col("hit.ts")) & (_over(b, F.col("target2")) | _under(b, F.col("entry")))), F.lit(0))
    return F.when(b.isNotNull(), F.struct(b["ts"].alias("ts"), F.when(_over(b, F.col("target2")), "t2_hit").otherwise("t1_then_breakeven").alias("event")))


def _settled(rows: DataFrame, unfinished: Column, without: Column) -> DataFrame:
    """Adds status, exit_price, exit_time and pnl_pct to alerts with hit, then and end (ts, close); drops these three."""
    c = F.col
    status = F.when(c("hit.event") != "t1", c("hit.event")).when(c("then").isNotNull(), c("then.event"))
    status = status.when(c("hit").isNull() & without.isNotNull(), without).when(unfinished, "open").when(c("hit").isNull(), "squareoff_no_t1").otherwise("t1_then_squareoff")
    out = rows.withColumn("status", status)
    last = c("status").isin("squareoff_no_t1", "t1_then_squareoff")
    price = F.when(c("status") == "time_stop", c("hit.close")).when(c("status") == "sl_hit", c("stop_loss")).when(c("status") == "t2_hit", c("target2")).when(c("status") == "t1_then_breakeven", c("entry")).when(last, c("end.close"))
    when_ = F.when(last, c("end.ts")).when(c("status").isin("t2_hit", "t1_then_breakeven") & c("then").isNotNull(), c("then.ts")).when(~c("status").isin("open", "no_data"), c("hit.ts"))
    out = out.withColumns({"exit_price": price, "exit_time": when_})
    return out.withColumn("pnl_pct", blended_pct()).drop("hit", "then", "end")


def blended_pct() -> Column:
    """Profit of a settled trade; half was taken at the first target where that was reached."""
    whole, half = (pnl_pct(F.col("entry"), F.col(x), F.col("direction")) for x in ("exit_price", "target1"))
    return F.when(F.col("status").isin(*PASS), (whole + half) / 2).otherwise(whole)


def resolve_intraday(alerts: DataFrame, bars: DataFrame, time_stop: str = "45 minutes", as_of: Column | None = None) -> DataFrame:
    """Outcomes within the alert's session. What is not decided squares off at the session's last bar.

    With as_of (a date), alerts of a session that is not over stay open. An alert without
    later bars has no_data and may be resolved again. A session's bars are one row, an
    array in order of time, so an alert meets one row, whatever the interval of the bars.
    """
    a = alerts.withColumn("session", F.to_date("generated_at"))
    sessions = bars.groupBy("symbol", "session").agg(F.sort_array(F.collect_list(F.struct("ts", "high", "low", "close"))).alias("__bars"))
    later = lambda b: b["ts"] > F.col("generated_at")
    met = a.join(sessions, ["symbol", "session"], "left").withColumn("hit", _first_event(F.col("__bars"), later, time_stop))
    met = met.withColumn("then", F.when(F.col("hit.event") == "t1", _second_event(F.col("__bars"), later)))
    last = F.element_at("__bars", -1)
    met = met.withColumn("end", F.when(later(last), F.struct(last["ts"].alias("ts"), last["close"].alias("close"))))
    # Through a generator, so that a filter on the outcome stays above it and does not look for the events again in every term.
    events = F.inline(F.array(F.struct("hit", "then", "end"))).alias("__hit", "__then", "__end")
    met = met.select("*", events).drop("hit", "then", "end", "__bars").withColumnsRenamed({"__hit": "hit", "__then": "then", "__end": "end"})
    unfinished = F.lit(False) if as_of is None else F.col("session") >= as_of
    return _settled(met, unfinished, F.when(F.col("end").isNull(), "no_data")).drop("session")


def extremum_blocks(days: DataFrame, period: str = "quarter") -> DataFrame:
    """(symbol, period, block, first, last, end, top, bottom, bars): runs of about the square root of a period's bars, with their extremes."""
    b = days.select("symbol", F.trunc("session", period).alias("period"), "session", "ts", "high", "low", "close")
    w = W.partitionBy("symbol", "period")
    size = F.ceil(F.sqrt(F.count("*").over(w)))
    b = b.withColumn("block", F.floor((F.row_number().over(w.orderBy("ts")) - 1) / size))
    bar = F.sort_array(F.collect_list(F.struct("ts", "session", "high", "low", "close")))
    return b.groupBy("symbol", "period", "block").agg(F.min("session").alias("first"), F.max("session").alias("last"), F.max("ts").alias("end"), F.max("high").alias("top"), F.min("low").alias("bottom"), bar.alias("bars"))


def narrowed(alerts: DataFrame, blocks: DataFrame, horizon: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What alerts meet on the way to their outcomes: periods' lists of blocks, blocks of a first event, blocks of a second one.

    A period's list tells which blocks can hold the event, from their extremes alone. The
    first such block may begin before the alert, and so hold it only there; the next one
    holds it for certain, so two blocks' bars are looked into at most.
    """
    levels = ["direction", "entry", "stop_loss", "target1", "target2"]
    span = F.sequence(F.trunc(F.date_add("gen_date", 1), "quarter"), F.date_add("gen_date", horizon), F.expr("interval 3 months"))
    a = alerts.select("alert_id", "symbol", *levels, F.to_date("generated_at").alias("gen_date")).withColumn("until", F.date_add("gen_date", horizon))
    index = blocks.groupBy("symbol", "period").agg(F.sort_array(F.collect_list(F.struct("block", "first", "last", "end", F.col("top").alias("high"), F.col("bottom").alias("low")))).alias("index"))
    inside = lambda x: (x["last"] > F.col("gen_date")) & (x["first"] <= F.col("until"))
    name = lambda x: F.struct(F.col("period").alias("period"), x["block"].alias("block"), x["end"].alias("end"))
    one = F.filter("index", lambda x: inside(x) & (_over(x, F.col("target1")) | _under(x, F.col("stop_loss"))))
    two = F.filter("index", lambda x: inside(x) & (_over(x, F.col("target2")) | _under(x, F.col("entry"))))
    lists = a.withColumn("period", F.explode(span)).join(index, ["symbol", "period"])
    lists = lists.select("alert_id", F.struct("symbol", *levels, "gen_date", "until").alias("a"), F.transform(F.slice(one, 1, 2), name).alias("one"), F.transform(two, name).alias("two"))
    both = lists.groupBy("alert_id").agg(F.first("a").alias("a"), F.slice(F.sort_array(F.flatten(F.collect_list("one"))), 1, 2).alias("one"), F.sort_array(F.flatten(F.collect_list("two"))).alias("two"))

    of = blocks.select("symbol", "period", "block", "bars")
    during = lambda b: (b["session"] > F.col("gen_date")) & (b["session"] <= F.col("until"))
    first = both.select("alert_id", "a.*", "two", F.explode("one").alias("at")).select("*", "at.period", "at.block").drop("at").join(of, ["symbol", "period", "block"])
    first = first.withColumn("hit", _first_event(F.col("bars"), during, None))
    hits = first.groupBy("alert_id").agg(F.min("hit").alias("hit"), F.first(F.struct("symbol", *levels, "gen_date", "until", "two")).alias("a"))
    later = F.slice(F.filter("a.two", lambda x: x["end"] > F.col("hit.ts")), 1, 2)
    second = hits.select("alert_id", "a.*", "hit", F.explode_outer(F.when(F.col("hit.event") == "t1", later)).alias("at")).select("*", "at.period", "at.block").drop("at", "two").join(of, ["symbol", "period", "block"], "left")
    return lists, first, second.withColumn("then", _second_event(F.col("bars"), during)).drop("bars")


#: Bars of a block up to which a quarter's bars, its square, are one array that every alert meets.
SHORT_BLOCK = 12


def in_arrays(alerts: DataFrame, blocks: DataFrame, horizon: int) -> DataFrame:
    """Alerts with hit, then and end from the bars of all quarters that their horizon touches, which are one row by symbol and first quarter."""
    starts = F.transform(F.sequence(F.lit(0), F.lit(horizon // 90 + 1)), lambda k: F.add_months("period", -3 * k))
    moved = blocks.select("symbol", F.explode(starts).alias("__period"), F.struct("period", "block", "bars").alias("b"))
    held = moved.groupBy("symbol", "__period").agg(F.flatten(F.sort_array(F.collect_list("b"))["bars"]).alias("__bars"))
    gen = F.to_date("generated_at")
    met = alerts.withColumn("__period", F.trunc(F.date_add(gen, 1), "quarter")).join(held, ["symbol", "__period"], "left")
    during = lambda b: (b["session"] > gen) & (b["session"] <= F.date_add(gen, horizon))
    met = met.withColumn("hit", _first_event(F.col("__bars"), during, None))
    met = met.withColumn("then", F.when(F.col("hit.event") == "t1", _second_event(F.col("__bars"), during)))
    events = F.inline(F.array(F.struct("hit", "then"))).alias("__hit", "__then")  # as in resolve_intraday
    out = met.select(*alerts.columns, events).withColumnsRenamed({"__hit": "hit", "__then": "then"})
    return out.withColumn("end", F.lit(None).cast("struct<ts:timestamp_ntz,close:double>"))


def resolve_swing(alerts: DataFrame, days: DataFrame, horizon: int = 60) -> DataFrame:
    """Outcomes over the bars of the `horizon` days after the alert's date; no time stop, and what is not decided, or has no later bars, stays open.

    days holds daily bars or any shorter ones. An alert meets the lists of blocks of the
    two quarters that its horizon touches and the bars of the blocks that can decide it,
    never all bars of the horizon. Where bars are so few that a quarter's are one short
    array, as daily ones are, it meets that instead, and moves once.
    """
    blocks = saved(extremum_blocks(days), "blocks")  # they are read three times
    if (blocks.agg(F.max(F.size("bars"))).first()[0] or 0) <= SHORT_BLOCK:
        return _settled(in_arrays(alerts, blocks, horizon), F.lit(True), F.lit(None).cast("string"))
    _, _, second = narrowed(alerts, blocks, horizon)
    got = second.groupBy("alert_id").agg(F.first("hit").alias("hit"), F.min("then").alias("then"))
    out = alerts.join(got, "alert_id", "left").withColumn("end", F.lit(None).cast("struct<ts:timestamp_ntz,close:double>"))
    return _settled(out, F.lit(True), F.lit(None).cast("string"))


def resolve_pending(alerts: DataFrame, outcomes: DataFrame, bars: DataFrame, days: DataFrame, as_of: Column, max_age: int = 60, time_stop: str = "45 minutes") -> DataFrame:
    """New outcomes of alerts that have none and are at most max_age days old, each by its category's resolver."""
    final = outcomes.where("status not in ('open', 'no_data')").select("alert_id")
    pending = alerts.where(F.col("trade_date") >= F.date_sub(as_of, max_age)).join(final, "alert_id", "left_anti")
    pending = pending.withColumn("direction", normal_direction(F.col("direction")))
    one = resolve_intraday(pending.where(F.col("category").isin(*INTRADAY_CATEGORIES)), bars, time_stop, as_of)
    two = resolve_swing(pending.where(F.col("category").isin(*SWING_CATEGORIES)), days)
    return one.unionByName(two).select("alert_id", "status", "exit_price", "exit_time", "pnl_pct")
