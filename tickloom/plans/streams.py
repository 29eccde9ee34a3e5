"""Queries that run the live forms: tables are landed in parts, a stream takes each part in a run of its own, and what it stored is read back."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.config import Gates
from tickloom.operators import filters as fl
from tickloom.operators import signals as sg
from tickloom.plans import queries as q
from tickloom.plans.registry import query, rounded, rsql
from tickloom.sources import bars as br
from tickloom.sources import files as fi
from tickloom.sources.shared import folder
from tickloom.streaming import live
from tickloom.streaming.carried import Carried
from tickloom.streaming.journal import append_new_rows, new_rows

#: Where the tables' days are parted, and a day after all of them.
CUT, END = "2024-01-16", dt.datetime(2024, 6, 1, 12)
BARS = ["symbol", "ts", "session", "open", "high", "low", "close", "volume"]
NAMES = ["view", "signup", "click", "error", "purchase"]


def _run(spark: SparkSession, start: Callable[[], StreamingQuery]) -> None:
    """Runs a stream to its end. Each shuffle partition keeps a state store, so there are no more of them than the cluster has cores."""
    key = "spark.sql.shuffle.partitions"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(int(was), max(8, spark.sparkContext.defaultParallelism))))
    try:
        start().awaitTermination()
    finally:
        spark.conf.set(key, was)


def _land(df: DataFrame, to: str) -> None:
    df.write.mode("append").parquet(to)


def _stream(spark: SparkSession, df: DataFrame, at: str) -> DataFrame:
    return spark.readStream.schema(df.schema).parquet(at)


@query("SELECT symbol, ts, open, high, low, close, volume FROM bar")
def stream_bars_1h(spark, sf):
    ticks = br.event_ticks(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    at, out, mark = (folder(spark, x) for x in ("ticks", "bars", "mark"))
    end = spark.createDataFrame([("end", END + dt.timedelta(days=k), k, 1.0, 1) for k in range(2)], "symbol string, ts timestamp_ntz, event_id long, px double, volume long")
    end = end.select(F.col("symbol"), F.col("ts").cast("timestamp").alias("ts"), *(F.col(c).cast(ticks.schema[c].dataType).alias(c) for c in ("event_id", "px", "volume")))
    for part in (ticks.where(f"ts < '{CUT}'"), ticks.where(f"ts >= '{CUT}'"), end):  # the last closes all windows before it
        _land(part, at)
        bars = live.stream_bars(_stream(spark, ticks, at)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
        _run(spark, bars.trigger(availableNow=True).start)
    got = spark.read.parquet(out).where("symbol <> 'end'")
    return got.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


FEATURES = ["atr14", "rsi14", "ema9", "ema20", "ema50", "vwap", "vwap_slope", "vol_ratio", "gap_pct"]


@query(f"SELECT symbol, session, rn, session_no, bar_no, swing_low, swing_high, orb3_high, orb6_low, {rsql(*FEATURES, digits=5)}, round(rvol, 5)+0.0 AS rvol FROM feat LEFT JOIN rv USING (symbol, session_no, bar_no)")
def carried_features(spark, sf):
    bars, carried = br.intraday(spark, sf).select(*BARS), Carried(folder(spark, "state"))
    parts = [bars.where(f"session < date'{CUT}'"), bars.where(f"session = date'{CUT}'"), bars.where(f"session >= date'{CUT}'")]  # a day comes twice
    out = None
    for number, part in enumerate(parts):
        rows = q.saved(carried.features(part, number), "features")
        out = rows if out is None else out.unionByName(rows)
    return rounded(out, keep=[*q.KEY, "session_no", "bar_no", "swing_low", "swing_high", "orb3_high", "orb6_low"], values=[*FEATURES, "rvol"], digits=5)


SCAN = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol) AS place FROM ({q.REGIME}) WHERE score >= 45 AND regime_ok) WHERE place <= 5"


@query(f"SELECT symbol, trade_date, setup, direction, {rsql('entry=close', 'stop_loss', digits=4)} FROM (SELECT *, session AS trade_date, 'score' || score AS setup, close - CASE WHEN direction = 'long' THEN 1 ELSE -1 END*unit AS stop_loss FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, score DESC, symbol) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY symbol, direction, session ORDER BY ts) AS k FROM ({SCAN})) WHERE k = 1) WHERE nth <= 3)")
def stream_scan_alerts(spark, sf):
    bars = br.intraday(spark, sf).select(*BARS)
    at, out, state, mark = (folder(spark, x) for x in ("bars", "alerts", "state", "mark"))
    for part in (bars.where(f"session < date'{CUT}'"), bars.where(f"session >= date'{CUT}'")):
        _land(part, at)
        _run(spark, lambda: live.run_scan(spark, _stream(spark, bars, at), out, state, mark, lambda f: live.judged(f, indices=["view"]), Gates(min_score=45, per_day=3), {"availableNow": True}))
    return rounded(spark.read.parquet(out), keep=["symbol", "trade_date", "setup", "direction"], values=["entry", "stop_loss"], digits=4)


ID = "CAST(split_part(alert_id, ':', 2) AS BIGINT)*10 + list_position(['view','signup','click','error','purchase'], symbol)"


@query(f"SELECT {ID} AS alert_id, status, exit_time, {rsql('exit_price', 'pnl_pct', digits=4)} FROM oc WHERE category IN ('scan','manual_intraday') AND status <> 'no_data' UNION ALL SELECT {ID}, status, CAST(CASE status WHEN 'sl_hit' THEN tsl WHEN 't2_hit' THEN t2 ELSE tbe END AS TIMESTAMP), round(x, 4)+0.0, round(CASE WHEN direction='long' THEN 1 ELSE -1 END*CASE WHEN status = 'sl_hit' THEN x-entry ELSE (x-entry+target1-entry)/2 END/entry*100, 4)+0.0 FROM (SELECT *, CASE status WHEN 'sl_hit' THEN stop_loss WHEN 't2_hit' THEN target2 ELSE entry END AS x FROM swt_out WHERE category NOT IN ('scan','manual_intraday') AND status <> 'open')".replace("swt_out", "(SELECT swo.*, g.t1, g.tsl, g.t2, g.tbe FROM swo JOIN (SELECT alert_id, any_value(t1) AS t1, min(session) FILTER (isl) AS tsl, min(session) FILTER (session >= t1 AND i2) AS t2, min(session) FILTER (session > t1 AND ibe) AS tbe FROM swt GROUP BY alert_id) g USING (alert_id))"))
def stream_outcomes(spark, sf):
    number = F.element_at(F.split("alert_id", ":"), 2).cast("long") * 10 + F.array_position(F.array(*map(F.lit, NAMES)), F.col("symbol"))
    alerts = q._alerts(spark, sf).withColumn("alert_id", number)
    bars = br.intraday(spark, sf).select(*BARS)
    end = spark.createDataFrame([("end", END + dt.timedelta(days=k), (END + dt.timedelta(days=k)).date(), 1.0, 1.0, 1.0, 1.0, 1.0) for k in range(2)], bars.schema)
    a, b, out, mark = (folder(spark, x) for x in ("alerts", "bars", "outcomes", "mark"))
    _land(alerts, a)
    for part in (bars.where(f"session < date'{CUT}'"), bars.where(f"session >= date'{CUT}'"), end):
        _land(part, b)
        _run(spark, lambda: live.run_resolver(_stream(spark, alerts, a), _stream(spark, bars, b), out, mark, time_stop=q.TIME_STOP, spread=2))
    return rounded(spark.read.parquet(out), keep=["alert_id", "status", "exit_time"], values=["exit_price", "pnl_pct"], digits=4)


@query("SELECT session, long_code AS reject_code, count(*) AS n FROM codes WHERE long_code IS NOT NULL GROUP BY ALL")
def stream_counters(spark, sf):
    log = q._feat(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), fl.reject_code(F.lit("long")).alias("reject_code")).where("reject_code is not null")
    at, out, mark = (folder(spark, x) for x in ("log", "counts", "mark"))
    for part in (log.where(f"ts < '{CUT}'"), log.where(f"ts >= '{CUT}'")):
        _land(part, at)
        _run(spark, lambda: live.run_counters(_stream(spark, log, at), out, mark))
    return live.counted(spark, out)


@query("SELECT DISTINCT symbol, direction, session FROM seta")
def stream_once_a_day(spark, sf):
    found = sg.setup_a(q._feat(spark, sf)).select("symbol", "setup", "direction", "session", F.col("ts").cast("timestamp").alias("ts"))
    at, out, mark = (folder(spark, x) for x in ("signals", "fired", "mark"))
    for part in (found.where(f"session < date'{CUT}'"), found.where(f"session >= date'{CUT}'")):
        _land(part, at)
        _land(part, at)  # all of them come twice
        fired = live.once_a_day(_stream(spark, found, at)).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark)
        _run(spark, fired.trigger(availableNow=True).start)
    return spark.read.parquet(out).select("symbol", "direction", "session")


def _land_messages(spark: SparkSession, sf: str, to: str) -> None:
    q._messages(spark, sf).write.option("compression", "gzip").json(to)


@query(f"SELECT channel, msg_id, symbol, action, entry FROM ({q.TIPS})")
def stream_tips(spark, sf):
    at, out = folder(spark, "messages"), folder(spark, "tips")
    _land_messages(spark, sf, at)
    for k in range(2):  # a second stream sees the same messages again
        _run(spark, lambda: live.run_tips(fi.messages(spark, at, stream=True), q._tickers(spark, sf), out, folder(spark, "mark"), period="year"))
    return spark.read.parquet(out).select("channel", "msg_id", "symbol", "action", "entry")


# --- landed files ----------------------------------------------------------------------------------------------


@query("SELECT symbol, session, ts, open, high, low, close, volume FROM bar WHERE session BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def bars_of_a_folder(spark, sf):
    root = folder(spark, "bars")
    br.write_bars(br.intraday(spark, sf).select(*BARS), root, "1h")
    return br.read_bars(spark, root, "1h").where("session between date'2024-01-05' and date'2024-01-20'").select("symbol", "session", "ts", "open", "high", "low", "close", "volume")


@query("SELECT symbol, as_of, arg_max(pct, p_partkey) AS delivery_pct FROM (SELECT 'SUP' || (p_partkey % 40) AS symbol, DATE '2024-01-01' + CAST(p_partkey % 31 AS INT) AS as_of, p_size*1.5 AS pct, p_partkey FROM part WHERE p_partkey % 5 <> 0 AND p_size > 10) GROUP BY ALL")
def delivery_of_a_folder(spark, sf):
    p, root = spark.read.parquet(f"{sf}/part.parquet"), folder(spark, "delivery")
    k = F.col("p_partkey")
    pct = F.when(F.col("p_size") > 10, (F.col("p_size") * 1.5).cast("string")).otherwise("-")  # some have no number, some are of another series
    rows = p.select(F.date_add(F.lit("2024-01-01").cast("date"), (k % 31).cast("int")).alias("day"), k, F.concat(F.lit(" sup"), (k % 40).cast("string")).alias("SYMBOL "), F.when(k % 5 == 0, " BE").otherwise(" EQ").alias(" SERIES"), pct.alias(" DELIV_PER"))
    rows = rows.repartition("day").sortWithinPartitions("day", "p_partkey").drop("p_partkey").withColumn("name", F.concat(F.lit("sec_"), F.date_format("day", "yyyy-MM-dd"))).drop("day")
    rows.write.option("header", True).option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False).partitionBy("name").csv(root)
    return fi.delivery_files(spark, root)


MASTER = "SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'NSE' ELSE 'BSE' END AS exch_seg, 'SUP' || s_suppkey || '-EQ' AS symbol, 'SUP' || s_suppkey AS name, '' AS instrumenttype, CAST(s_suppkey AS VARCHAR) AS token FROM supplier UNION ALL SELECT 'NFO', 'SUP' || s_suppkey || '24JANFUT', 'SUP' || s_suppkey, 'FUTSTK', CAST(s_suppkey + 100000 AS VARCHAR) FROM supplier WHERE s_acctbal > 2000"


@query(MASTER)
def instrument_master(spark, sf):
    root = folder(spark, "master")
    rows = q._master(spark, sf).withColumn("part", F.pmod(F.xxhash64("token"), F.lit(8)))  # arrays of bounded length, one in a file
    rows.groupBy("part").agg(F.to_json(F.collect_list(F.struct("exch_seg", "symbol", "name", "instrumenttype", "token"))).alias("value")).write.partitionBy("part").text(root)
    return fi.instrument_master(spark, root).select("exch_seg", "symbol", "name", "instrumenttype", "token")


@query("SELECT 'SUP' || s_suppkey AS symbol, DATE '2024-01-01' + CAST(s_suppkey % 60 AS INT) AS results_date FROM supplier WHERE s_suppkey % 3 <> 0")
def results_of_a_folder(spark, sf):
    root, k = folder(spark, "calendar"), F.col("s_suppkey")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (k % 60).cast("int"))
    told = F.when(k % 3 == 0, "Dividend").otherwise("Financial Results")  # in two fields and three spellings of dates, plain and wrapped
    event = F.struct(F.concat(F.lit(" sup"), k.cast("string")).alias("symbol"), F.when(k % 4 == 0, F.date_format(day, "dd-MMM-yyyy")).when(k % 4 == 1, F.date_format(day, "dd-MM-yyyy")).otherwise(day.cast("string")).alias("date"), F.when(k % 2 == 0, told).alias("purpose"), F.when(k % 2 == 1, told).alias("bm_desc"))
    rows = spark.read.parquet(f"{sf}/supplier.parquet").select(event.alias("e"), F.pmod(F.xxhash64(k), F.lit(6)).alias("part"))
    rows = rows.groupBy("part").agg(F.collect_list("e").alias("data"))
    rows.select("part", F.when(F.col("part") % 2 == 0, F.to_json("data")).otherwise(F.to_json(F.struct("data"))).alias("value")).write.partitionBy("part").text(root)
    return fi.results_calendar(spark, root)


STATED = "CASE WHEN o_orderkey % 7 = 0 THEN 'BUY or SELL' WHEN o_orderkey % 2 = 0 THEN 'buy' ELSE 'Go short' END || ' SUP' || (o_orderkey % 90) || ' @ ' || p || CASE WHEN o_orderkey % 3 <> 0 THEN ', SL ' || (p-12) ELSE '' END || ' TGT ' || (p+13)"


@query(f"SELECT 'docs' AS channel, doc_id AS msg_id, substring(text, 1, 1000) AS raw_text FROM documents WHERE trim(text) <> '' UNION ALL SELECT 'ch' || (o_orderkey % 4), o_orderkey, {STATED} FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) % 9000 + 1000 AS p FROM orders)")
def messages_and_raw_tips(spark, sf):
    at, out = folder(spark, "messages"), folder(spark, "raw")
    _land_messages(spark, sf, at)
    rows = fi.messages(spark, at).withColumnRenamed("text", "raw_text")
    for _ in range(2):  # what is stored already is not stored again
        append_new_rows(new_rows(fi.raw_tips(rows), ["channel", "msg_id"], "ts", out, "year"), out)
    return spark.read.parquet(out).select("channel", "msg_id", "raw_text")
