"""Landed files of the outside world: instrument master, delivery, results calendar, news, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MASTER = "exch_seg string, symbol string, name string, instrumenttype string, token string"
EVENT = "struct<symbol:string,date:string,purpose:string,bm_desc:string>"
MESSAGES = "channel string, msg_id long, ts timestamp_ntz, text string"


def instrument_master(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MASTER).option("multiLine", True).json(path)


def delivery(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """(symbol, as_of, delivery_pct) of a market file with padded headers: the EQ series (all rows without a series), numbers only, the last row of a symbol."""
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    series = F.trim("SERIES") if "SERIES" in raw.columns else F.lit("EQ")
    rows = raw.where(series == "EQ").select(F.upper(F.trim("SYMBOL")).alias("symbol"), F.trim("DELIV_PER").try_cast("double").alias("pct"), F.monotonically_increasing_id().alias("i"))
    return rows.where("pct is not null").groupBy("symbol").agg(F.max_by("pct", "i").alias("delivery_pct")).select("symbol", F.lit(as_of).cast("date").alias("as_of"), "delivery_pct")


def delivery_files(spark: SparkSession, root: str) -> DataFrame:
    """delivery() of a folder of such files of one layout, each with its day as yyyy-mm-dd in its name or its folder's, or as ddmmyyyy in its name; others are left out."""
    raw = spark.read.option("header", True).csv(root).select("*", F.col("_metadata.file_path").alias("__path"), F.monotonically_increasing_id().alias("__i"))
    raw = raw.toDF(*(c.strip() for c in raw.columns))
    name, place = F.element_at(F.split("__path", "/"), -1), F.substring_index("__path", "/", -2)
    day = F.coalesce(F.try_to_date(F.regexp_extract(place, "([0-9]{4}-[0-9]{2}-[0-9]{2})", 1), "yyyy-MM-dd"), F.try_to_date(F.regexp_extract(name, "([0-9]{8})", 1), "ddMMyyyy"))
    series = F.trim("SERIES") if "SERIES" in raw.columns else F.lit("EQ")
    rows = raw.where(series == "EQ").select(F.upper(F.trim("SYMBOL")).alias("symbol"), day.alias("as_of"), F.trim("DELIV_PER").try_cast("double").alias("pct"), "__i")
    return rows.where("pct is not null and as_of is not null").groupBy("symbol", "as_of").agg(F.max_by("pct", "__i").alias("delivery_pct"))


def any_date(s: Column) -> Column:
    """A date in one of three spellings; NULL for anything else."""
    s = F.trim(s)
    return F.coalesce(*(F.try_to_date(s, f) for f in ("dd-MMM-yyyy", "dd-MM-yyyy", "yyyy-MM-dd")))


def results_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, results_date) of a calendar file: a list of events, or an object that holds the list as data or as its first list."""
    text = spark.read.option("wholetext", True).text(path)
    plain = F.from_json("value", f"array<{EVENT}>")
    wrapped = F.map_values(F.from_json("value", "map<string,string>"))
    lists = F.filter(F.transform(wrapped, lambda v: F.from_json(v, f"array<{EVENT}>")), lambda x: x.isNotNull())
    named = F.from_json(F.get_json_object("value", "$.data"), f"array<{EVENT}>")
    rows = text.select(F.explode(F.when(F.ltrim("value").startswith("["), plain).otherwise(F.coalesce(named, F.get(lists, 0)))).alias("e")).select("e.*")
    about = F.lower(F.coalesce("purpose", "bm_desc")).contains("result")
    return rows.where(about).select(F.upper(F.trim("symbol")).alias("symbol"), any_date(F.col("date")).alias("results_date")).where("symbol <> '' and results_date is not null")


def next_results(calendar: DataFrame, today: Column) -> DataFrame:
    """The nearest results date of each symbol from today on."""
    return calendar.where(F.col("results_date") >= today).groupBy("symbol").agg(F.min("results_date").alias("results_date"))


def newest_news(news: DataFrame, k: int = 3, title_chars: int = 110) -> DataFrame:
    """The k newest titled articles (symbol, published_at, title, source, url) of each symbol."""
    w = W.partitionBy("symbol").orderBy(F.desc("published_at"), "url")
    out = news.where("title is not null").withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return out.withColumn("title", F.substring("title", 1, title_chars))


def messages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Channel messages (channel, msg_id, ts, text) that were landed as JSON lines, as a table or as a stream; those without text are left out."""
    source = spark.readStream if stream else spark.read
    return source.schema(MESSAGES).json(path).where("trim(text) <> ''")


def raw_tips(tips: DataFrame, text_chars: int = 1000) -> DataFrame:
    """Tips as they are stored: with the time of their arrival, and text of bounded length."""
    return tips.withColumn("raw_text", F.substring("raw_text", 1, text_chars)).withColumn("received_at", F.current_timestamp())
