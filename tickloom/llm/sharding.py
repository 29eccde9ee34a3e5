"""Sharding by proportional stratified interleaving.

Rows of a source are shuffled by a seeded hash and ranked; the rank r of n becomes the
fraction (2r - 1) / 2n; all rows sorted by fraction are cut into shards of equal count.
Every stretch of that order holds each source in proportion, so every shard matches the
mixture.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import saved, spread_join

#: Rows that one ranking task sorts, on average.
BUCKET_ROWS = 1024
#: Buckets of one run of prefix sums.
RUN = 1024


def seeded(seed: int, *columns: str) -> Column:
    """A shuffle key that any engine can compute: hexadecimal MD5 of the seed and the columns."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)))


def ranked(rows: DataFrame, by: list[str], order: list[str], bucket: Column, into: str) -> DataFrame:
    """Adds the 1-based rank of each row among the rows of equal `by`, in the order of bucket and then `order`.

    bucket must ascend with `order` inside equal `by`. Bucket counts are summed first and
    their prefix sums give each bucket's first rank, so a window sorts one bucket only,
    however many rows share `by`. The prefix sums have two levels, runs of RUN buckets
    and the buckets of a run, so no task gets all buckets either.
    """
    placed = rows.withColumn("__bucket", bucket)
    counts = placed.groupBy(*by, "__bucket").agg(F.count("*").alias("__n"))
    counts = counts.withColumn("__run", F.floor(F.col("__bucket") / RUN))
    runs = counts.groupBy(*(F.col(c).alias(f"__{c}") for c in by), F.col("__run").alias("__at_run")).agg(F.sum("__n").alias("__held"))
    runs = runs.withColumn("__first", F.coalesce(F.sum("__held").over(W.partitionBy(*(f"__{c}" for c in by)).orderBy("__at_run").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    met = counts.join(runs, [F.col("__run") == F.col("__at_run"), *(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by)]).select(*counts.columns, "__first")
    inner = F.coalesce(F.sum("__n").over(W.partitionBy(*by, "__run").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = met.select(*(F.col(c).alias(f"__{c}") for c in by), F.col("__bucket").alias("__b"), (F.col("__first") + inner).alias("__base"))
    inside = placed.withColumn("__r", F.row_number().over(W.partitionBy(*by, "__bucket").orderBy(*order)))
    on = [F.col("__bucket") == F.col("__b"), *(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by)]
    return inside.join(bases, on).withColumn(into, F.col("__base") + F.col("__r")).drop("__bucket", "__b", "__base", "__r", *(f"__{c}" for c in by))


def known_key(c: Column) -> Column:
    """c as a struct that is never null and sorts nulls last, so plain joins meet null keys too."""
    return F.struct(c.isNull().alias("z"), F.coalesce(c.cast("string"), F.lit("")).alias("c"))


def interleave(rows: DataFrame, key: list[str], stratum: str = "source", shards: int = 40, seed: int = 17, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds shard (0 to shards - 1) and slot (gapless from 0 in each shard) to every row.

    Shards' counts are at most one apart, and each holds every stratum in proportion to
    its rows. key orders rows of equal hash; rows equal in all of key are interchangeable.
    A null stratum is a stratum of its own; an empty table gives no rows; with fewer rows
    than shards some shards are empty. All columns are kept, whatever their names; one
    named shard or slot is refused. Rows equal in all of key are ranked in one task.
    """
    if clash := {"shard", "slot"}.intersection(c.lower() for c in rows.columns):
        raise ValueError(f"columns of the result exist already: {sorted(clash)}")
    keys = [f"key{i}" for i in range(len(key))]
    # The caller's columns travel in a struct, so no name of theirs meets one in use here.
    own = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("kept"), known_key(F.col(stratum)).alias("by"), seeded(seed, *key).alias("h"), *(F.col(c).alias(k) for c, k in zip(key, keys, strict=True)))
    hashed = saved(own, "hashed")  # the result rests on it
    sizes = hashed.groupBy("by").agg(F.count("*").alias("size"))
    n = hashed.count()
    buckets = max(1, n // bucket_rows)
    first = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    one = ranked(hashed, ["by"], ["h", *keys], first, "rank")
    share = spread_join(one, sizes.withColumn("n", F.col("size")), "by", "n", n).withColumn("frac", (2 * F.col("rank") - 1) / (2 * F.col("size")))
    second = F.floor(F.col("frac") * F.lit(buckets)).cast("long")
    two = ranked(share.withColumn("zero", F.lit(0)), ["zero"], ["frac", "by", "h", *keys], second, "at")
    n = max(n, 1)
    shard = F.expr(f"cast(((at - 1) * {shards}) div {n} as int)")
    begin = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return two.withColumn("shard", shard).withColumn("slot", F.col("at") - 1 - begin).select("kept.*", "shard", "slot")
