"""Bars: from files, from ticks, and from the tables at hand."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.config import MARKET_ZONE, OTHER_PERIOD_DAYS, PERIOD_DAYS, interval_of

BARS = "symbol string, ts timestamp_ntz, session date, open double, high double, low double, close double, volume double"


def read_bars(spark: SparkSession, root: str, name: str = "5m") -> DataFrame:
    """Bars of one interval from a folder partitioned by interval and session; filters on both prune folders."""
    interval_of(name)
    return spark.read.schema(BARS + ", interval string").parquet(root).where(F.col("interval") == name).drop("interval")


def write_bars(bars: DataFrame, root: str, name: str) -> None:
    interval_of(name)
    bars.withColumn("interval", F.lit(name)).write.mode("append").partitionBy("interval", "session").parquet(root)


def in_period(bars: DataFrame, period: str, as_of: object) -> DataFrame:
    """Bars of the sessions that a period name looks back on from as_of (a date or a date column)."""
    days = PERIOD_DAYS.get(period, OTHER_PERIOD_DAYS)
    to = as_of if not isinstance(as_of, str) else F.lit(as_of).cast("date")
    return bars.where((F.col("session") >= F.date_sub(to, days)) & (F.col("session") <= to))


def in_market_zone(rows: DataFrame, column: str = "ts", source: str = "UTC", zone: str = MARKET_ZONE) -> DataFrame:
    """rows with the wall-clock times of `column` turned from the zone `source` to the market's.

    A column of instants (timestamp) needs no source: its session's zone is taken. The
    session date, the entry window and the market's hours are those of the market's
    clock, so times of other zones pass here before bars are numbered.
    """
    c, kind = F.col(column), rows.schema[column].dataType.typeName()
    at = F.convert_timezone(F.current_timezone(), F.lit(zone), c.cast("timestamp_ntz")) if kind == "timestamp" else F.convert_timezone(F.lit(source), F.lit(zone), c)
    out = rows.withColumn(column, at)
    return out.withColumn("session", F.to_date(column)) if "session" in rows.columns else out


def numbered(bars: DataFrame) -> DataFrame:
    """Adds bar_no in the session, rn in the symbol's history and session_no, all from 1."""
    by_session, by_symbol = W.partitionBy("symbol", "session").orderBy("ts"), W.partitionBy("symbol").orderBy("session", "ts")
    first = (F.lag("session").over(by_symbol).isNull() | (F.lag("session").over(by_symbol) != F.col("session"))).cast("int")
    out = bars.withColumn("rn", F.row_number().over(by_symbol)).withColumn("__first", first)
    out = out.withColumn("session_no", F.sum("__first").over(by_symbol.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__first")
    return out.withColumn("bar_no", F.row_number().over(by_session))


def bars_from_ticks(ticks: DataFrame, name: str = "1h") -> DataFrame:
    """Bars of ticks (symbol, ts, px, volume) in tumbling windows; the first and last tick by ts and event_id open and close one."""
    at = F.struct("ts", "event_id")
    out = ticks.groupBy("symbol", F.window("ts", interval_of(name)).alias("w")).agg(
        F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"), F.sum("volume").cast("double").alias("volume"))
    ts = F.col("w.start").cast("timestamp_ntz")
    return out.select("symbol", F.to_date(ts).alias("session"), ts.alias("ts"), "open", "high", "low", "close", "volume")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of the events table: a symbol for each event type, whose price drifts with the sum of values.

    Sums run inside an hour, on top of prefix sums of the hours' totals, so no task sorts
    all events of a type.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("hour", F.date_trunc("hour", "ts")).withColumn("step", F.round(F.col("value") * 100).cast("long") - 4963)
    hours = e.groupBy("event_type", "hour").agg(F.sum("step").alias("total"))
    before = F.coalesce(F.sum("total").over(W.partitionBy("event_type").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    e = e.join(hours.select("event_type", "hour", before.alias("before")), ["event_type", "hour"])
    run = F.col("before") + F.sum("step").over(W.partitionBy("event_type", "hour").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0))
    volume = F.get_json_object("props", "$.k").cast("long") + 1
    return e.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.round(100 * F.exp(5e-7 * run), 2).alias("px"), volume.alias("volume"))


def intraday(spark: SparkSession, sf_dir: str, name: str = "1h") -> DataFrame:
    return numbered(bars_from_ticks(event_ticks(spark, sf_dir), name))


#: Rows of the symbols that one task sorts, on average.
TASK_ROWS = 150_000


def by_key(rows: DataFrame, key: str, task_rows: int = TASK_ROWS) -> DataFrame:
    """rows dealt by key to as many tasks as keep each near task_rows, however many rows there are; a small table as it is."""
    tasks = math.ceil(rows.count() / task_rows)
    return rows if tasks <= 1 else rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), key)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the lineitem table: a symbol for each supplier, whose price drifts with the sum of quantities."""
    items = by_key(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_suppkey")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    w = W.partitionBy("l_suppkey").orderBy(*order)
    run = F.sum((F.col("l_quantity") * 10).cast("long") - 255).over(w.rowsBetween(W.unboundedPreceding, 0))
    ticks = items.select(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("session"), F.row_number().over(w).alias("k"), F.round(100 * F.exp(0.00005 * run), 2).alias("px"), F.col("l_quantity").alias("q"))
    out = ticks.groupBy("symbol", "session").agg(F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("q").alias("volume"))
    return numbered(out.withColumn("ts", F.col("session").cast("timestamp_ntz")))


def coverage(bars: DataFrame, days: int) -> DataFrame:
    """Days that each symbol's bars span, and whether that is under 60 % of what was asked for."""
    span = F.datediff(F.max("session"), F.min("session")) + 1
    return bars.groupBy("symbol").agg(span.alias("span_days"), F.count("*").alias("n_bars")).withColumn("is_short", F.col("span_days") < 0.6 * days)
