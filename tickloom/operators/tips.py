"""Trade tips in messages: extraction by built-in expressions, the gate on our own vote, channel scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.config import GATES
from tickloom.operators.alerts import as_alerts

#: Words that name a side, labels that precede prices, and upper-case words that are no tickers. Fixed values.
BUY_WORDS = "BUY|LONG|BULLISH|GO\\s*LONG|ENTER\\s*LONG|BUY\\s*ABOVE"
SELL_WORDS = "SELL|SHORT|BEARISH|GO\\s*SHORT|ENTER\\s*SHORT|SELL\\s*BELOW"
ENTRY_LABELS = "@|\\bat\\b|\\bentry\\b|\\bbuy\\s*at\\b|\\bsell\\s*at\\b|\\bcmp\\b|\\blevel\\b"
TARGET_LABELS = "\\btarget\\b|\\btgt\\b|\\bt1\\b|\\btp\\b|\\btarget\\s*1\\b"
TARGET2_LABELS = "\\bt2\\b|\\btarget\\s*2\\b|\\btp2\\b"
STOP_LABELS = "\\bsl\\b|\\bstop\\s*loss\\b|\\bstoploss\\b|\\bstop\\b"
NO_TICKERS = (
    "BUY", "SELL", "SHORT", "LONG", "TGT", "TARGET", "SL", "STOP", "LOSS", "CMP", "ENTRY", "EXIT", "BULLISH", "BEARISH", "BREAKOUT", "BREAKDOWN",
    "NIFTY", "BANKNIFTY", "SENSEX", "INTRADAY", "SWING", "BUYING", "SELLING", "AT", "ABOVE", "BELOW", "GO", "ENTER", "BOOK", "PROFIT", "VOL",
    "VOLUME", "QTY", "RSI", "MACD", "EMA", "SMA", "ATR", "VWAP", "CALL", "PUT", "PE", "CE", "STRIKE", "EXPIRY", "OI", "FII", "DII", "IPO", "PSU",
    "NEWS", "RESULTS", "Q1", "Q2", "Q3", "Q4", "FY25", "FY26",
)


def price_after(text: Column, labels: str) -> Column:
    """The first price of two to six digits after a label; NULL without one."""
    return F.regexp_extract(text, f"(?i)(?:{labels})\\s*:?\\s*₹?\\s*([0-9]{{2,6}}(?:\\.[0-9]{{1,2}})?)", 1).try_cast("double")


def extract_tips(messages: DataFrame, universe: DataFrame, text_chars: int = 500) -> DataFrame:
    """One tip for each message (channel, msg_id, ts, text) with a known ticker and words of one side only.

    The first upper-case token that is a symbol of universe (symbol) is the tip's; tokens
    meet the universe by a join, so it may be of any size. Prices are read once, before
    tokens are taken apart, and go along with them.
    """
    text = F.col("text")
    buy, sell = (text.rlike(f"(?i)\\b(?:{words})\\b") for words in (BUY_WORDS, SELL_WORDS))
    prices = {"entry": ENTRY_LABELS, "target": TARGET_LABELS, "target2": TARGET2_LABELS, "stop_loss": STOP_LABELS}
    named = F.array_except(F.regexp_extract_all("text", F.lit("\\b[A-Z][A-Z0-9-]{1,14}\\b"), F.lit(0)), F.array(*map(F.lit, NO_TICKERS)))
    rows = messages.where(buy != sell).withColumn("action", F.when(buy, "BUY").otherwise("SELL"))
    rows = rows.select("channel", "msg_id", F.struct("ts", "action", *(price_after(text, v).alias(k) for k, v in prices.items()), F.substring(F.trim("text"), 1, text_chars).alias("raw_text")).alias("tip"), F.posexplode(named).alias("pos", "symbol"))
    first = rows.join(universe.select("symbol").distinct(), "symbol").groupBy("channel", "msg_id").agg(F.min_by(F.struct("symbol", "tip"), "pos").alias("x"))
    return first.select("channel", "msg_id", "x.tip.ts", "x.symbol", "x.tip.action", *(f"x.tip.{k}" for k in prices), "x.tip.raw_text")


def agreement(action: Column, signal: Column) -> Column:
    return F.when(action == signal, "Agreement").when(signal == "HOLD", "Neutral").otherwise("Conflict")


def gate(tips: DataFrame, voted: DataFrame, rejected: DataFrame | None = None, least: float = GATES.swing_confidence) -> DataFrame:
    """Tips with our signal, their agreement and what becomes of them: passed, error, low_confidence or failed_filter.

    voted (symbol, signal, confidence) has a row for each symbol that could be analysed;
    rejected (symbol, direction, code) the gate code of each symbol and direction.
    """
    out = tips.join(voted, "symbol", "left")
    code = F.lit(None).cast("string")
    if rejected is not None:
        out = out.withColumn("direction", F.when(F.col("action") == "BUY", "long").otherwise("short")).join(rejected, ["symbol", "direction"], "left")
        code = F.col("code")
    ok = F.col("signal").isin("BUY", "SELL") & (F.col("confidence") >= least)
    outcome = F.when(F.col("signal").isNull(), "error").when(~ok, "low_confidence").when(code.isNotNull(), "failed_filter").otherwise("passed")
    return out.withColumns({"outcome": outcome, "agreement": F.when(F.col("signal").isNotNull(), agreement(F.col("action"), F.col("signal")))})


def digest(gated: DataFrame, every: int = 10) -> DataFrame:
    """Counts by outcome of each run of `every` tips of a channel.

    Tips are ranked inside their channel's days, on top of prefix sums of the days'
    counts, so no task sorts a whole channel.
    """
    day = F.to_date("ts")
    counts = gated.groupBy("channel", day.alias("day")).agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(W.partitionBy("channel").orderBy("day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(F.col("channel").alias("__channel"), F.col("day").alias("__day"), before.alias("__before"))
    gated = gated.withColumn("day", day).join(bases, (F.col("channel") == F.col("__channel")) & F.col("day").eqNullSafe(F.col("__day")))
    n = F.col("__before") + F.row_number().over(W.partitionBy("channel", "day").orderBy("ts", "msg_id"))
    return gated.withColumn("run", F.floor((n - 1) / every)).groupBy("channel", "run", "outcome").agg(F.count("*").alias("n"))


def scorecard_alerts(passed: DataFrame) -> DataFrame:
    """Alerts of tips that passed: the channel's own calls where they name all levels, and our plan of the same symbol.

    passed has the tip's prices and plan_entry, plan_stop, plan_target1 and plan_target2.
    """
    setup = F.concat(F.lit("@"), "channel")
    call = passed.where("entry is not null and target is not null and stop_loss is not null").select("symbol", "ts", setup.alias("setup"), F.when(F.col("action") == "BUY", "long").otherwise("short").alias("direction"), "entry", "stop_loss", F.col("target").alias("target1"), F.coalesce("target2", "target").alias("target2"))
    own = passed.where("plan_entry is not null").select("symbol", "ts", setup.alias("setup"), F.when(F.col("signal") == "BUY", "long").otherwise("short").alias("direction"), F.col("plan_entry").alias("entry"), F.col("plan_stop").alias("stop_loss"), F.col("plan_target1").alias("target1"), F.col("plan_target2").alias("target2"))
    return as_alerts(call, "channel_call").unionByName(as_alerts(own, "channel_tip"))
