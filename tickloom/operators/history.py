"""Signals of the past and what became of them, for all bars of all symbols at once; and walk-forward selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.config import COST_PCT, GATES, REPLAY_BARS, Gates, Session
from tickloom.operators.filters import atr_code, in_entry_window, reject_code
from tickloom.operators.outcomes import resolve_intraday
from tickloom.operators.signals import DETECTORS
from tickloom.operators.universe import with_membership
from tickloom.sources.shared import saved


def long_enough(rows: DataFrame, bars: int = REPLAY_BARS) -> DataFrame:
    """Rows of symbols with so many bars: a shorter history is not replayed at all."""
    return rows.withColumn("__bars", F.max("rn").over(W.partitionBy("symbol"))).where(F.col("__bars") >= bars).drop("__bars")


def candidates(feat: DataFrame, g: Gates = GATES, warm_up: int = 30, session: Session = Session(), low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Detected bars after the warm-up, inside the entry window, that pass the gates as a long and in their own direction, of symbols with enough bars."""
    rows = long_enough(feat).where((F.col("rn") >= warm_up) & in_entry_window(F.col("ts"), session)).withColumn("long_code", reject_code(F.lit("long"), g, low=low, high=high)).where("long_code is null").drop("long_code")
    out = None
    for detect in DETECTORS.values():
        found = detect(rows)
        out = found if out is None else out.unionByName(found)
    return out.where(reject_code(F.col("direction"), g, low=low, high=high).isNull())


def first_signals(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy("ts"))).where("__k = 1").drop("__k")


def _trades(signals: DataFrame, bars: DataFrame, time_stop: str) -> DataFrame:
    a = signals.withColumn("generated_at", F.col("ts")).select("alert_id", "symbol", "setup", "direction", "generated_at", "entry", "stop_loss", "target1", "target2", *(c for c in ("param", "score") if c in signals.columns))
    return resolve_intraday(a, bars, time_stop)


def setup_history(feat: DataFrame, g: Gates = GATES, session: Session = Session(), time_stop: str = "45 minutes") -> DataFrame:
    """Trades of the setups: the first signal of each symbol, setup and session; one without later bars stays, with profit 0."""
    first = first_signals(candidates(feat, g, session=session), ["symbol", "setup", "session"])
    out = _trades(first.withColumn("alert_id", F.concat_ws(":", "symbol", "setup", F.col("rn").cast("string"))), feat, time_stop)
    return out.withColumn("pnl_pct", F.coalesce("pnl_pct", F.lit(0.0)))


def score_history(scored: DataFrame, bars: DataFrame, least: int = 90, session: Session = Session(), time_stop: str = "45 minutes") -> DataFrame:
    """Trades of the score: the first bar of each symbol and session that reaches `least` and has a later bar, of symbols with enough bars."""
    end = F.max("bar_no").over(W.partitionBy("symbol", "session"))
    sizes = long_enough(bars).select("symbol", "session", "ts", end.alias("session_bars"))
    rows = scored.where((F.col("score") >= least) & (F.col("direction") != "none") & in_entry_window(F.col("ts"), session)).join(sizes, ["symbol", "session", "ts"]).where("bar_no < session_bars")
    first = first_signals(rows, ["symbol", "session"]).withColumn("setup", F.concat(F.lit("score"), F.col("score").cast("string")))
    return _trades(first.withColumn("alert_id", F.concat_ws(":", "symbol", F.col("rn").cast("string"))), bars, time_stop)


def folds(sessions: DataFrame, n: int) -> DataFrame:
    """(session, fold): the sessions in order, cut into n runs of near-equal length whose bounds round half to even."""
    listed = sessions.select("session").distinct().withColumn("i", F.row_number().over(W.orderBy("session")) - 1).withColumn("m", F.count("*").over(W.partitionBy()))
    fold = sum((F.col("i") >= F.bround(F.lit(k) * F.col("m") / n)).cast("int") for k in range(1, n)) if n > 1 else F.lit(0)
    return listed.select("session", fold.alias("fold"))


def walk_forward(feat: DataFrame, grid: DataFrame, n_folds: int = 4, train_folds: int = 2, g: Gates = GATES, session: Session = Session(), time_stop: str = "45 minutes", anchored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Trades out of sample, as a written table, and the log of folds (fold, param, train_mean, n_train), param being the row (param, lo, hi) of grid chosen on the folds before.

    All parameters' trades are made once: bars are gated by the widest band of the grid and
    detected, and only those signals meet the grid's rows. A fold takes the parameter of the best mean net return
    on its training folds, the first in grid order among equals, none where none traded.
    """
    least, most = grid.agg(F.min("lo"), F.max("hi")).first()
    found = candidates(feat, g, session=session, low=F.lit(least), high=F.lit(most)).crossJoin(grid).where(atr_code(F.col("lo"), F.col("hi")).isNull())
    first = first_signals(found, ["param", "symbol", "setup", "session"])
    named = first.withColumn("alert_id", F.concat_ws(":", F.col("param").cast("string"), "symbol", "setup", F.col("rn").cast("string")))
    trades = _trades(named, feat, time_stop).withColumn("pnl_pct", F.coalesce("pnl_pct", F.lit(0.0))).withColumn("session", F.to_date("generated_at"))
    trades = saved(trades.join(folds(feat, n_folds), "session").withColumn("net", F.col("pnl_pct") - F.lit(COST_PCT)), "trades")
    tests = grid.sparkSession.range(train_folds, n_folds).select(F.col("id").cast("int").alias("test"))
    low = F.lit(0) if anchored else F.col("test") - train_folds
    train = trades.join(tests, (F.col("fold") >= low) & (F.col("fold") < F.col("test")))
    means = train.groupBy("test", "param").agg(F.avg("net").alias("train_mean"), F.count("*").alias("n_train"))
    best = means.withColumn("place", F.row_number().over(W.partitionBy("test").orderBy(F.desc("train_mean"), "param"))).where("place = 1")
    log = best.select(F.col("test").alias("fold"), "param", "train_mean", "n_train")
    return trades.join(log.select("fold", "param"), ["fold", "param"]), log


def as_listed(trades: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Trades of a history with member and survivorship_biased on the day of their signal (see with_membership)."""
    return with_membership(trades.withColumn("session", F.to_date("generated_at")), snapshots).drop("session")
