"""The alert journal: selection, deduplication, caps, appends, upserts and lookups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.config import GATES, Gates
from tickloom.operators.score import gate_reason
from tickloom.sources.shared import saved

KEY = ["category", "user_id", "symbol", "setup", "direction", "generated_at"]

ALERTS = "category string, user_id long, symbol string, setup string, direction string, entry double, stop_loss double, target1 double, target2 double, generated_at timestamp_ntz, alert_id long, signal_key string, trade_date date"
OUTCOMES = "alert_id long, status string, exit_price double, exit_time timestamp_ntz, pnl_pct double, resolved_at timestamp"


def alert_id() -> Column:
    """The same alert has the same id in any run."""
    return F.xxhash64(*KEY)


def signal_key() -> Column:
    return F.concat_ws(":", "symbol", "setup", "direction", F.col("session").cast("string"))


def top_per_pass(scored: DataFrame, g: Gates = GATES) -> DataFrame:
    """The best bars that may fire at each time: score first, then symbol."""
    ok = scored.where(gate_reason(g).isNull())
    return ok.withColumn("place", F.row_number().over(W.partitionBy("ts").orderBy(F.desc("score"), "symbol"))).where(F.col("place") <= g.per_pass)


def first_of_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.withColumn("__k", F.row_number().over(W.partitionBy(*keys).orderBy("ts"))).where("__k = 1").drop("__k")


def capped(rows: DataFrame, per_day: int = GATES.per_day, already: DataFrame | None = None) -> DataFrame:
    """The first rows of each session up to the daily cap, in order of time, score and symbol; already (session, fired) counts earlier ones."""
    nth = F.row_number().over(W.partitionBy("session").orderBy("ts", F.desc("score"), "symbol"))
    out = rows.withColumn("nth", nth)
    if already is not None:
        out = out.join(already, "session", "left").withColumn("nth", F.col("nth") + F.coalesce("fired", F.lit(0))).drop("fired")
    return out.where(F.col("nth") <= per_day)


def autoscan(scored: DataFrame, g: Gates = GATES, fired: DataFrame | None = None, already: DataFrame | None = None) -> DataFrame:
    """Alerts of the live scan: gates, the best of each pass, once per symbol, direction and session, and the daily cap.

    fired (signal_key) holds keys of earlier runs, so a second run over the same bars adds nothing.
    """
    rows = top_per_pass(scored, g).withColumn("setup", F.lit("score"))
    rows = first_of_key(rows, ["symbol", "direction", "session"]).withColumn("signal_key", signal_key())
    if fired is not None:
        rows = rows.join(fired, "signal_key", "left_anti")
    rows = capped(rows, g.per_day, already)
    return as_alerts(rows.withColumn("setup", F.concat(F.lit("score"), F.col("score").cast("string"))), "scan").withColumn("signal_key", F.concat_ws(":", "symbol", F.lit("score"), "direction", F.col("trade_date").cast("string")))


def as_alerts(rows: DataFrame, category: str, user: Column | None = None) -> DataFrame:
    out = rows.select(F.lit(category).alias("category"), (F.lit(None).cast("long") if user is None else user).alias("user_id"), F.col("symbol").cast("string").alias("symbol"), "setup", "direction", "entry", "stop_loss", "target1", "target2", F.col("ts").alias("generated_at"), F.to_date("ts").alias("trade_date"))
    return out.withColumn("alert_id", alert_id())


def append(alerts: DataFrame, root: str) -> None:
    alerts.write.mode("append").partitionBy("trade_date").parquet(root)


def append_new(rows: DataFrame, stored: DataFrame, key: str, root: str) -> None:
    """Appends rows whose key is not stored yet; a repeated row counts once."""
    rows.dropDuplicates([key]).join(stored.select(key), key, "left_anti").write.mode("append").parquet(root)


def latest_versions(rows: DataFrame, key: str = "alert_id", at: str = "resolved_at") -> DataFrame:
    """The newest version of each key: the reading side of an upsert whose writing side appends."""
    newest = F.max_by(F.struct(*rows.columns), at)
    return rows.groupBy(F.col(key).alias("__key")).agg(newest.alias("r")).select("r.*")


def kept_days(rows: DataFrame, as_of: Column, days: int, date: str = "session") -> DataFrame:
    return rows.where(F.col(date) >= F.date_sub(as_of, days))


def with_outcomes(alerts: DataFrame, outcomes: DataFrame, on: Column | None = None, category: str | None = None, user_id: int | None = None) -> DataFrame:
    """Alerts of a day (and category, and user or everyone) with their outcomes where they have one."""
    rows = alerts if on is None else alerts.where(F.col("trade_date") == on)
    rows = rows if category is None else rows.where(F.col("category") == category)
    rows = rows if user_id is None else rows.where(f"user_id = {int(user_id)} or user_id is null")
    return rows.join(outcomes, "alert_id", "left")


def open_alerts(alerts: DataFrame, outcomes: DataFrame, as_of: Column, max_age: int = 60) -> DataFrame:
    return alerts.where(F.col("trade_date") >= F.date_sub(as_of, max_age)).join(outcomes.select("alert_id"), "alert_id", "left_anti")


def resolved_alerts(alerts: DataFrame, outcomes: DataFrame, categories: tuple[str, ...], user_id: int | None = None) -> DataFrame:
    rows = alerts.where(F.col("category").isin(*categories))
    rows = rows if user_id is None else rows.where(F.col("user_id") == user_id)
    return rows.join(outcomes, "alert_id")


def journal_order(rows: DataFrame, by: str = "generated_at") -> DataFrame:
    """Journal rows as they are read: alerts by when they were made, or outcomes by when they were settled; then by id."""
    return rows.orderBy(by, "alert_id")


def mark_notified(rows: DataFrame, root: str) -> None:
    """Appends the ids of alerts whose users have been told, which unnotified() then leaves out."""
    rows.select("alert_id", F.current_timestamp().alias("notified_at")).write.mode("append").parquet(root)


def unnotified(alerts: DataFrame, outcomes: DataFrame, notified: DataFrame, categories: tuple[str, ...], statuses: tuple[str, ...]) -> DataFrame:
    rows = resolved_alerts(alerts.where("user_id is not null"), outcomes.where(F.col("status").isin(*statuses)), categories)
    return rows.join(notified.select("alert_id"), "alert_id", "left_anti")


def watchlists(events: DataFrame) -> DataFrame:
    """(user_id, symbol, added_at) of what users watch, from add and remove events (user_id, symbol, at, action); adding twice keeps the first."""
    removed = events.where("action = 'remove'").groupBy("user_id", "symbol").agg(F.max("at").alias("gone"))
    held = events.where("action = 'add'").join(removed, ["user_id", "symbol"], "left").where("gone is null or at > gone")
    return held.groupBy("user_id", "symbol").agg(F.min("at").alias("added_at"))


#: Users and symbols in blocks that meet, and users in a task, on average.
BLOCK_USERS, BLOCK_SYMBOLS, TASK_USERS = 512, 256, 8_192


def _blocks(rows: DataFrame, column: str, blocks: int, tasks: int) -> DataFrame:
    """Lists of the values of a column, NULL among them, by their hash."""
    placed = rows.select(column, F.pmod(F.xxhash64(column), F.lit(blocks)).alias("__block")).repartition(tasks, "__block")
    return placed.groupBy("__block").agg(F.transform(F.collect_list(F.struct(column)), lambda x: x[column]).alias(f"__{column}s")).drop("__block")


def watched_or_default(users: DataFrame, watchlist: DataFrame, universe: DataFrame) -> DataFrame:
    """(user_id, symbol): each user's watchlist, or the whole universe for a user without one.

    Users without a watchlist meet the universe in blocks of both: their rows are as many
    as ever, but come in runs of a symbol and a short list of users again and again, which
    files compress. A task has the pairs of two blocks in memory, and there are as many
    tasks as users need.
    """
    n, m = users.count(), universe.count()
    blocks = max(1, math.ceil(n / BLOCK_USERS))
    tasks = min(blocks, max(users.sparkSession.sparkContext.defaultParallelism, math.ceil(n / TASK_USERS)))
    bare = _blocks(users.select("user_id").join(watchlist, "user_id", "left_anti"), "user_id", blocks, tasks)
    pairs = bare.crossJoin(F.broadcast(_blocks(universe, "symbol", max(1, math.ceil(m / BLOCK_SYMBOLS)), 1)))
    pairs = pairs.coalesce(tasks)  # as many as there are: it parts the steps, so a pair of blocks is taken apart before the next is made
    default = pairs.select("__user_ids", F.explode("__symbols").alias("symbol")).select(F.explode("__user_ids").alias("user_id"), "symbol")
    own = watchlist.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "symbol")
    return own.unionByName(default)


def watchlist_of(watchlist: DataFrame, user_id: int) -> DataFrame:
    """A user's symbols in the order in which they were added."""
    return watchlist.where(F.col("user_id") == user_id).orderBy("added_at", "symbol")


def swing_shortlist(users: DataFrame, watchlist: DataFrame, universe: DataFrame, planned: DataFrame, g: Gates = GATES) -> tuple[DataFrame, DataFrame]:
    """Each user's best BUY and SELL symbols by confidence, and a summary of how many were scanned, actionable, below and cut.

    A user without a watchlist has the universe. It is ranked and summed up once, and
    only its best rows and one row of counts meet these users. planned, a row for each
    symbol, is written first, since both kinds of users need it.
    """
    planned = saved(planned, "planned")
    actionable = F.col("signal").isin("BUY", "SELL")
    ok = actionable & (F.col("confidence") >= g.swing_confidence)
    counts = [F.count("*").alias("scanned"), F.count_if(ok).alias("actionable"), F.count_if(actionable & ~ok).alias("below"), F.greatest(F.count_if(ok) - g.swing_per_user, F.lit(0)).alias("cut")]

    def best(rows: DataFrame, by: list[str]) -> DataFrame:
        place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("confidence"), "symbol"))
        return rows.where(ok).withColumn("place", place).where(F.col("place") <= g.swing_per_user)

    bare = users.select("user_id").join(watchlist, "user_id", "left_anti")
    own = watchlist.join(users.select("user_id"), "user_id", "left_semi").select("user_id", "symbol").join(planned, "symbol")
    rest = universe.select("symbol").join(planned, "symbol")
    shared = best(rest.withColumn("__all", F.lit(0)), ["__all"]).drop("__all")  # per_user rows
    total = rest.groupBy().agg(*counts).where("scanned > 0")  # one row
    shortlist = best(own, ["user_id"]).unionByName(bare.crossJoin(F.broadcast(shared)))
    return shortlist, own.groupBy("user_id").agg(*counts).unionByName(bare.crossJoin(F.broadcast(total)))


def swing_alerts(shortlist: DataFrame, fired: DataFrame | None = None) -> DataFrame:
    """swing_auto alerts of a shortlist whose rows have a plan (session, ts, entry, stop_loss, target1, target2): one for each user, symbol and day.

    fired (signal_key) holds keys of alerts made before, so a second run of a day adds none.
    """
    rows = shortlist.where("entry is not null").withColumns({"direction": F.col("signal"), "setup": F.lit(None).cast("string")})
    out = as_alerts(rows, "swing_auto", F.col("user_id").cast("long"))
    out = out.withColumn("signal_key", F.concat_ws(":", F.lit("swing"), F.col("user_id").cast("string"), "symbol", "direction", F.col("trade_date").cast("string")))
    return out if fired is None else out.join(fired.select("signal_key"), "signal_key", "left_anti")


def outbox(alerts: DataFrame, subscribers: DataFrame) -> DataFrame:
    """One row for each alert and subscriber."""
    return subscribers.select("user_id").crossJoin(alerts.select("alert_id", "symbol", "direction"))


def completions(pending: DataFrame, record: DataFrame) -> DataFrame:
    """Finished trades to tell users of, each with the user's running record."""
    return pending.join(record.withColumnsRenamed({"net": "record_net", "wins": "record_wins", "losses": "record_losses"}).select("user_id", "record_net", "record_wins", "record_losses"), "user_id", "left")
