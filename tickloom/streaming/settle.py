"""Pending alerts settled by keyed state: each is decided by the bars that come after it, and no table is read again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.config import INTRADAY_CATEGORIES, SWING_CATEGORIES
from tickloom.operators.outcomes import blended_pct, normal_direction

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BAR, ALERT = 0, 1
_EVENT = "kind int, us long, day int, open_us long, close_us long, high double, low double, close double, alert_id long, intraday boolean, long boolean, entry double, stop double, target1 double, target2 double, late_us long, until_us long"
_PENDING = "alert_id long, intraday boolean, long boolean, entry double, stop double, target1 double, target2 double, us long, day int, late_us long, until_us long, reached boolean, done boolean, last_us long, last_close double"
_DAY = "day int, open_us long, close_us long, high double, low double"
_OUT = "alert_id long, status string, exit_price double, exit_us long, direction string, entry double, target1 double"
_OUTCOME = Row(*(x.split()[0] for x in _OUT.split(", ")))


class Pending:
    """An alert on its way: which of its levels bars have reached so far."""

    def __init__(self, row: tuple) -> None:
        (self.alert_id, self.intraday, self.long, self.entry, self.stop, self.target1, self.target2, self.us, self.day, self.late_us, self.until_us, self.reached, self.done, self.last_us, self.last_close) = row

    def row(self) -> tuple:
        return (self.alert_id, self.intraday, self.long, self.entry, self.stop, self.target1, self.target2, self.us, self.day, self.late_us, self.until_us, self.reached, self.done, self.last_us, self.last_close)

    def over(self, level: float | None, high: float, low: float) -> bool:
        return level is not None and (high >= level if self.long else low <= level)

    def under(self, level: float | None, high: float, low: float) -> bool:
        return level is not None and (low <= level if self.long else high >= level)

    def settled(self, status: str, price: float | None, us: int) -> tuple:
        self.done = True
        return (self.alert_id, status, price, us, "long" if self.long else "short", self.entry, self.target1)

    def meet(self, us: int, high: float, low: float, close: float) -> tuple | None:
        """The outcome if this bar decides it: time stop, stop, targets and return to the entry in the order of the batch resolver."""
        self.last_us, self.last_close = us, close
        if not self.reached:
            if self.intraday and us > self.late_us:
                return self.settled("time_stop", close, us)
            if self.under(self.stop, high, low):
                return self.settled("sl_hit", self.stop, us)
            if not self.over(self.target1, high, low):
                return None
            self.reached = True
            return self.settled("t2_hit", self.target2, us) if self.over(self.target2, high, low) else None
        if self.over(self.target2, high, low):
            return self.settled("t2_hit", self.target2, us)
        return self.settled("t1_then_breakeven", self.entry, us) if self.under(self.entry, high, low) else None

    def square_off(self) -> tuple | None:
        """What is left when an intraday alert's session is over; nothing for one that met no bar."""
        if self.last_us is None:
            self.done = True
            return None
        return self.settled("t1_then_squareoff" if self.reached else "squareoff_no_t1", self.last_close, self.last_us)


class Settler(StatefulProcessor):
    """State of one symbol's alerts: rows that the watermark has not passed, the alerts on their way, and the day so far.

    Rows are taken in order of event time once the watermark has passed them, so the cuts
    of batches, and late rows within the delay, change nothing. A swing alert meets whole
    days, an intraday one bars; a timer stands at the next row, session end or horizon.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _EVENT)
        self.pending = handle.getListState("pending", _PENDING)
        self.today = handle.getValueState("today", _DAY)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        names = [x.split()[0] for x in _EVENT.split(", ")]
        return self._advance([tuple(r[n] for n in names) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        return self._advance([], timerValues.getCurrentWatermarkInMs())

    def _advance(self, rows: list[tuple], watermark_ms: int) -> Iterator[Row]:
        passed = watermark_ms * 1000
        rows += list(self.waiting.get()) if self.waiting.exists() else []
        alerts = [Pending(x) for x in self.pending.get()] if self.pending.exists() else []
        today = self.today.get() if self.today.exists() else None
        out: list[tuple | None] = []

        def end_of_day() -> None:
            nonlocal today
            day, open_us, _, high, low = today
            for a in alerts:
                if not a.done and a.intraday and a.day <= day:
                    out.append(a.square_off())
                elif not a.done and not a.intraday and a.day < day and open_us < a.until_us:
                    out.append(a.meet(open_us, high, low, None))
            today = None

        known = {a.alert_id for a in alerts}
        for kind, us, day, open_us, close_us, high, low, close, *alert in sorted((r for r in rows if r[1] <= passed), key=lambda r: (r[1], r[0])):
            if today is not None and day > today[0]:
                end_of_day()
            if kind == ALERT:
                alert_id, intraday, long, entry, stop, target1, target2, late_us, until_us = alert
                if alert_id not in known:  # else it has come before
                    known.add(alert_id)
                    alerts.append(Pending((alert_id, intraday, long, entry, stop, target1, target2, us, day, late_us, until_us, False, False, None, None)))
                continue
            today = (day, open_us, close_us, high, low) if today is None else (*today[:3], max(today[3], high), min(today[4], low))
            out += [a.meet(us, high, low, close) for a in alerts if a.intraday and not a.done and a.day == day and us > a.us]
        if today is not None and today[2] <= passed:
            end_of_day()
        for a in alerts:
            if a.intraday and not a.done and a.until_us <= passed:
                out.append(a.square_off())
        alerts = [a for a in alerts if a.until_us > passed]  # settled ones are remembered until then
        rows = [r for r in rows if r[1] > passed]
        self._keep(self.waiting, rows)
        self._keep(self.pending, [a.row() for a in alerts])
        if today is None:
            self.today.clear()
        else:
            self.today.update(tuple(today))
        ahead = [r[1] for r in rows] + [a.until_us for a in alerts] + ([today[2]] if today is not None else [])
        if ahead:
            self.handle.registerTimer(min(ahead) // 1000 + 1)
        return iter([_OUTCOME(*x) for x in out if x is not None])

    @staticmethod
    def _keep(state: object, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def settle(alerts: DataFrame, bars: DataFrame, delay: str = "30 minutes", time_stop: str = "45 minutes", horizon: int = 60, spread: int = 1) -> DataFrame:
    """Outcomes (alert_id, status, exit_price, exit_time, pnl_pct) of a stream of alerts by a stream of bars, each once.

    They are those of resolve_pending: intraday alerts by the bars of their session, which
    squares off when the watermark passes its end, swing alerts by the days made of bars.
    What bars never decide gives no row and is forgotten at the session's end or the
    horizon. bars' times make the watermark; bars and alerts more than `delay` behind it
    are too late. The state is by symbol; spread deals a symbol's alerts to so many keys,
    each of which gets the symbol's bars. Needs the RocksDB state store (see run_resolver).
    """
    day = F.to_date("ts")
    times = {"us": _us(F.col("ts")), "day": F.unix_date(day), "open_us": _us(day), "close_us": _us(F.date_add(day, 1))}
    buckets = F.sequence(F.lit(0), F.lit(spread - 1))
    none = lambda kind: F.lit(None).cast(kind)
    b = bars.select(F.col("symbol").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "high", "low", "close").withWatermark("ts", delay)
    b = b.select("symbol", F.explode(buckets).alias("bucket"), "ts", F.lit(BAR).alias("kind"), *(v.alias(k) for k, v in times.items()), "high", "low", "close", none("long").alias("alert_id"), none("boolean").alias("intraday"), none("boolean").alias("long"), *(none("double").alias(k) for k in ("entry", "stop", "target1", "target2")), none("long").alias("late_us"), none("long").alias("until_us"))
    intraday = F.col("category").isin(*INTRADAY_CATEGORIES)
    a = alerts.where(F.col("category").isin(*INTRADAY_CATEGORIES, *SWING_CATEGORIES)).withColumn("ts", F.col("generated_at").cast("timestamp"))
    a = a.select("symbol", F.pmod(F.xxhash64("alert_id"), F.lit(spread)).cast("int").alias("bucket"), "ts", F.lit(ALERT).alias("kind"), *(v.alias(k) for k, v in times.items()), *(none("double").alias(k) for k in ("high", "low", "close")), "alert_id", intraday.alias("intraday"), (normal_direction(F.col("direction")) == "long").alias("long"), "entry", F.col("stop_loss").alias("stop"), "target1", "target2",
                 (_us(F.col("ts") + F.expr(f"interval {time_stop}"))).alias("late_us"), F.when(intraday, _us(F.date_add(day, 1))).otherwise(_us(F.date_add(day, horizon + 1))).alias("until_us"))
    found = b.unionByName(a).groupBy("symbol", "bucket").transformWithState(Settler(), _OUT, "Append", "EventTime")
    found = found.withColumn("exit_time", F.timestamp_micros("exit_us").cast("timestamp_ntz"))
    return found.select("alert_id", "status", "exit_price", "exit_time", blended_pct().alias("pnl_pct"))


def use_rocksdb(spark: SparkSession) -> None:
    """Streams with keyed state and timers need this state store; a session that names another one is left alone."""
    if "HDFSBacked" in spark.conf.get(PROVIDER, "HDFSBacked"):
        spark.conf.set(PROVIDER, ROCKSDB)
