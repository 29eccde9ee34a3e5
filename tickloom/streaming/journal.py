"""Stored tables that streams append to: versions that are compacted day by day, and keys that are looked up by bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.alerts import latest_versions
from tickloom.sources.shared import delete, names

LEDGER = "trade_date date, gen int, at timestamp"
GONE = -1


class Versions:
    """Rows whose later versions replace earlier ones, by day and generation: root/trade_date=.../gen=.../.

    Appends go to a day's generation. A compaction writes the latest version of each key
    as the next generation and then, in one small append, enters it in a ledger; until
    that row is there every reader sees the old generation, and from then on the new one,
    so nobody sees a part of it. The ledger's days are those that were ever compacted and
    not cleared away; they are listed to name partitions. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str = "alert_id", at: str = "resolved_at") -> None:
        self.spark, self.root, self.schema, self.key, self.at = spark, root, schema, key, at

    def _generations(self) -> dict[object, int]:
        if not names(self.spark, f"{self.root}/_ledger"):
            return {}
        rows = self.spark.read.schema(LEDGER).parquet(f"{self.root}/_ledger").groupBy("trade_date").agg(F.max_by("gen", "at").alias("gen"))
        return {r["trade_date"]: r["gen"] for r in rows.collect()}

    @staticmethod
    def _current(generations: dict[object, int]) -> Column:
        if not generations:
            return F.lit(0)
        listed = F.create_map(*(F.lit(x) for pair in generations.items() for x in pair))
        return F.coalesce(listed[F.col("trade_date")], F.lit(0))

    def append(self, rows: DataFrame) -> None:
        """Appends versions with trade_date; those of days that are gone are left out."""
        placed = rows.withColumn("gen", self._current(self._generations())).where(F.col("gen") != GONE)
        placed.write.mode("append").partitionBy("trade_date", "gen").parquet(self.root)

    def stored(self) -> DataFrame:
        """All versions of each day's generation; a filter on trade_date, like that on gen, prunes folders."""
        if not [x for x in names(self.spark, self.root) if x.startswith("trade_date=")]:
            return self.spark.createDataFrame([], f"{self.schema}, trade_date date, gen int")
        rows = self.spark.read.schema(f"{self.schema}, trade_date date, gen int").parquet(self.root)
        return rows.where(F.col("gen") == self._current(self._generations()))

    def read(self) -> DataFrame:
        """The latest version of each key."""
        return latest_versions(self.stored().drop("gen"), self.key, self.at)

    def compact(self, days: Column | None = None) -> None:
        """Leaves one version of each key in the days for which `days` holds (all without it). Running it again after a failure replaces what that left."""
        rows = self.stored() if days is None else self.stored().where(days)
        newest = latest_versions(rows, self.key, self.at).withColumn("gen", F.col("gen") + 1)
        newest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trade_date", "gen").parquet(self.root)
        self._enter(rows.select("trade_date", (F.col("gen") + 1).alias("gen")).distinct())

    def purge(self, before: Column) -> None:
        """Drops the days before a date; their folders go, and so do generations that were replaced before the last compaction."""
        self._enter(self.stored().where(F.col("trade_date") < before).select("trade_date", F.lit(GONE).alias("gen")).distinct())
        for day, gen in self._generations().items():
            for name in names(self.spark, f"{self.root}/trade_date={day}"):
                old = name.startswith("gen=") and int(name[4:]) < gen - 1
                if gen == GONE or old:
                    delete(self.spark, f"{self.root}/trade_date={day}/{name}")

    def _enter(self, rows: DataFrame) -> None:
        rows.select("trade_date", F.col("gen").cast("int").alias("gen"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").parquet(f"{self.root}/_ledger")


#: Buckets of a day's keys.
BUCKETS = 16


def with_bucket(rows: DataFrame, keys: list[str], at: str, period: str = "day") -> DataFrame:
    """Adds day, that of the row's time or the first of its period (week, month, year), and bucket, under which a row's keys are stored."""
    return rows.withColumns({"day": F.to_date(at) if period == "day" else F.trunc(at, period), "bucket": F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")})


def stored_near(spark: SparkSession, rows: DataFrame, root: str, schema: str) -> DataFrame:
    """What is stored in the days and buckets of rows (day, bucket), by a filter on partitions: other folders are not read."""
    if not [x for x in names(spark, root) if x.startswith("day=")]:
        return spark.createDataFrame([], f"{schema}, day date, bucket int")
    wanted = rows.select("day", "bucket").distinct().collect()  # BUCKETS for each day of a batch at most
    days = {r["day"] for r in wanted}
    there = F.col("day").isin(sorted(days - {None})) & F.col("bucket").isin(sorted({r["bucket"] for r in wanted}))
    there = there | F.col("day").isNull() if None in days else there
    return spark.read.schema(f"{schema}, day date, bucket int").parquet(root).where(there)


def new_rows(rows: DataFrame, keys: list[str], at: str, root: str, period: str = "day") -> DataFrame:
    """Rows with day and bucket whose keys are not stored under root yet; of repeated keys one.

    A key's time decides its day, so a message that comes again, however late, is looked
    for where it was stored. A longer period than a day makes fewer folders of sparse keys.
    Rows meet the stored keys by a union and move once, with whatever they carry.
    """
    placed = with_bucket(rows, keys, at, period)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    known = stored_near(rows.sparkSession, placed, root, schema).select(*keys, "day", "bucket", F.lit(True).alias("__known"))
    both = placed.withColumn("__known", F.lit(False)).unionByName(known, allowMissingColumns=True).repartition(*keys)
    fresh = both.withColumn("__known", F.max("__known").over(W.partitionBy(*keys, "day"))).where("not __known")
    nth = F.row_number().over(W.partitionBy(*keys).orderBy("day"))
    return fresh.withColumn("__nth", nth).where("__nth = 1").drop("__known", "__nth")


def append_new_rows(rows: DataFrame, root: str) -> None:
    """Appends rows of new_rows(), a folder's rows of a batch as one file."""
    rows.repartition("day", "bucket").write.mode("append").partitionBy("day", "bucket").parquet(root)
