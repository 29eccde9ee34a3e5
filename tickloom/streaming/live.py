"""The live forms: bars from a tick stream, the scan of each micro-batch, tips, counters and pending outcomes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.config import GATES, Gates, interval_of
from tickloom.operators import score as sc
from tickloom.operators.alerts import ALERTS, append, autoscan
from tickloom.operators.features import index_trend
from tickloom.operators.tips import extract_tips, gate
from tickloom.sources.files import raw_tips
from tickloom.streaming.carried import Carried
from tickloom.streaming.journal import append_new_rows, new_rows
from tickloom.streaming.settle import settle, use_rocksdb


def stream_bars(ticks: DataFrame, name: str = "1h", late: str = "10 minutes") -> DataFrame:
    """Bars of a tick stream (symbol, ts timestamp, event_id, px, volume) in tumbling windows; ticks behind the watermark are dropped."""
    at = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", late).groupBy(F.window("ts", interval_of(name)).alias("w"), "symbol").agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.sum("volume").cast("double").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def once_a_day(signals: DataFrame, keep: str = "2 days") -> DataFrame:
    """The first of each signal key in a stream (symbol, setup, direction, session, ts); keys are forgotten when the watermark has passed them."""
    return signals.withWatermark("ts", keep).dropDuplicatesWithinWatermark(["symbol", "setup", "direction", "session"])


def counters(scan_log: DataFrame, keep: str = "1 day") -> DataFrame:
    """Rejections of each session and reason of a scan log stream (ts timestamp, reject_code), for output mode update.

    Counts are by day of the event time, so a session's counts leave the state when the
    watermark, `keep` behind the newest row, has passed its end.
    """
    per = scan_log.withWatermark("ts", keep).groupBy(F.window("ts", "1 day").alias("w"), "reject_code").agg(F.count("*").alias("n"))
    return per.select(F.to_date("w.start").alias("session"), "reject_code", "n")


def run_counters(scan_log: DataFrame, root: str, checkpoint: str, keep: str = "1 day", trigger: dict | None = None) -> StreamingQuery:
    """Starts the counters' sink: each batch's changed counts are a folder of its own, replaced if the batch runs again."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")

    writer = counters(scan_log, keep).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def counted(spark: SparkSession, root: str) -> DataFrame:
    """(session, reject_code, n): the latest count of each key. Counts only grow, so that is the highest."""
    rows = spark.read.schema("session date, reject_code string, n long, batch long").parquet(root)
    return rows.groupBy("session", "reject_code").agg(F.max("n").alias("n"))


def judged(feat: DataFrame, indices: list[str] | None = None, results: DataFrame | None = None) -> DataFrame:
    """Scores of a batch's features with their gates: the trend of index symbols among them, and the calendar (symbol, results_date) if given."""
    scored = sc.score(feat)
    scored = sc.with_regime(scored, index_trend(feat.where(F.col("symbol").isin(indices)))) if indices else scored.withColumn("regime_ok", F.lit(True))
    return sc.with_events(scored, results) if results is not None else scored.withColumn("event_ok", F.lit(True))


def run_scan(spark: SparkSession, bars: DataFrame, alerts_root: str, state_root: str, checkpoint: str, judge: Callable[[DataFrame], DataFrame] = judged, g: Gates = GATES, trigger: dict | None = None) -> StreamingQuery:
    """Starts the live scan: each micro-batch of raw bars is scored with its symbols' history, selected and appended to the alert table.

    The history is the bounded state in state_root (see Carried), so a batch's features
    are those of all bars so far. The keys and the number of alerts of the batch's
    sessions come from the alert table's folders of these days, so a batch that runs again
    after a failure adds nothing and the daily cap holds across batches.
    """
    carried = Carried(state_root)

    def each(batch: DataFrame, number: int) -> None:
        feat = carried.features(batch, number)
        days = [r[0] for r in batch.select("session").distinct().collect()]  # the few days of a batch
        stored = _stored(spark, alerts_root, ALERTS)
        fired = already = None
        if stored is not None:
            held = stored.where("category = 'scan'").where(F.col("trade_date").isin(days))
            fired = held.select("signal_key")
            already = held.groupBy(F.col("trade_date").alias("session")).agg(F.count("*").alias("fired"))
        append(autoscan(judge(feat), g, fired, already), alerts_root)

    writer = bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 minutes"})).start()


def _stored(spark: SparkSession, root: str, schema: str) -> DataFrame | None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(root)
    there = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(root) if there else None


def run_tips(messages: DataFrame, universe: DataFrame, root: str, checkpoint: str, analysis: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]] | None = None, trigger: dict | None = None, period: str = "day") -> StreamingQuery:
    """Starts the tip audit: every message batch's tips are appended with their time of arrival and text cut to 1000 characters.

    analysis gives, for a batch's tips, our votes (symbol, signal, confidence) and gate
    codes (symbol, direction, code) or None; with it each tip is stored with its outcome
    at the gate and its agreement with our vote. A message seen before adds nothing: tips
    are stored by day (or another period) and bucket of their keys, and a batch looks
    into its own only.
    """
    keys = ["channel", "msg_id"]

    def each(batch: DataFrame, _: int) -> None:
        tips = new_rows(extract_tips(batch, universe, text_chars=1000), keys, "ts", root, period)
        if analysis is not None:
            voted, rejected = analysis(tips)
            tips = gate(tips, voted, rejected)
        append_new_rows(raw_tips(tips), root)

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def run_resolver(alerts: DataFrame, bars: DataFrame, outcomes_root: str, checkpoint: str, delay: str = "30 minutes", time_stop: str = "45 minutes", horizon: int = 60, spread: int = 1, trigger: dict | None = None) -> StreamingQuery:
    """Starts the resolver: outcomes of a stream of alerts by a stream of bars (see settle), appended once each.

    What is pending is the stream's own state; neither alerts nor outcomes are read again.
    """
    use_rocksdb(bars.sparkSession)
    out = settle(alerts, bars, delay, time_stop, horizon, spread).withColumn("resolved_at", F.current_timestamp())
    return out.writeStream.format("parquet").option("path", outcomes_root).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
