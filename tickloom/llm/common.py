"""Helpers shared by the operators: reading tables, cutting lineage in the shared folder, Arrow rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a new one where that is unset and one machine runs all (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved(df: DataFrame, what: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and returns the table: lineage ends there, and a lost executor costs nothing that was written."""
    return written(df, new_folder(df.sparkSession, what))


class Scratch:
    """Tables that an operator needs while it runs; they are deleted when the block ends.

    What leaves the block must rest on no table of it: an operator hands on a table that
    it has written with saved().
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def saved(self, df: DataFrame, what: str = "step") -> DataFrame:
        self.paths.append(new_folder(self.spark, what))
        return written(df, self.paths[-1])

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for path in self.paths:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Name of the column that tells rows apart inside the operators, and of others that they add for a while.
ROW, AT = "__tickloom_row", "__tickloom_at"


def file_row(docs: DataFrame) -> Column | None:
    """A column that tells the rows of a Parquet table apart and is the same on every reading: file and index in it.

    None for a frame that has no such column. A join or explode of a table repeats its
    rows' values, so it is of use for a table as it was read, filtered or not.
    """
    try:
        meta = docs.metadataColumn("_metadata")
        row = F.struct(F.xxhash64(meta["file_path"]).alias("f"), meta["row_index"].alias("i"))
        docs.select(row)
    except AnalysisException:
        return None
    return row


def with_row(docs: DataFrame, row: Column | None) -> DataFrame:
    """docs with ROW, from `row` where the caller has such a column; else docs is written first, with numbers."""
    if row is None:
        return saved(docs.withColumn(ROW, F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("i"))), "rows")
    return docs.withColumn(ROW, row)


#: A key with more than one in so many of all rows is cut into pieces of about so many by hash before a join.
PIECES = 1000


def spread_join(rows: DataFrame, small: DataFrame, on: str, n: str, total: int) -> DataFrame:
    """Joins rows with small by the column `on`; n says how many of about `total` rows have the key, in small and, if it is known there, in rows.

    A key of more than 1 / PIECES of all rows is cut into pieces by hash, and its row of
    small is copied to each, so that no task gets a whole hot key. Where rows do not know
    n, the hot keys are listed first; they are fewer than PIECES, however many rows there
    are. n comes back from rows only.
    """
    pieces = F.greatest(F.ceil(F.col(n) * PIECES / F.lit(max(1, total))), F.lit(1)).cast("int")
    place = F.xxhash64(*rows.columns)
    if n in rows.columns:
        left = rows.withColumn("__piece", F.pmod(place, pieces).cast("int"))
    else:
        hot = small.where((F.col(n) * PIECES > total) & F.col(on).isNotNull()).select(F.col(on).alias("__on"), pieces.alias("__pieces")).distinct()
        listed = hot.collect()
        if not listed:
            return rows.join(small.drop(n), on)
        known = rows.sparkSession.createDataFrame(listed, hot.schema)
        left = rows.join(F.broadcast(known), F.col(on) == F.col("__on"), "left").withColumn("__piece", F.coalesce(F.pmod(place, F.col("__pieces")), F.lit(0)).cast("int")).drop("__on", "__pieces")
    right = small.withColumn("__piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop(n)
    return left.join(right, [on, "__piece"]).drop("__piece")


def parts(spark: SparkSession) -> int:
    """Shuffle partitions of this session, the parallelism the cluster's owner asked for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def chunked(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of neighbouring texts of about `most` bytes (one text at least), each with the number of its first."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield begin, texts[begin:i]
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, texts[begin:]


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]], schema: str | StructType) -> DataFrame:
    """mapInArrow with a state for each task: make() is called once in a task and its result for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield from each(batch)

    return df.mapInArrow(run, schema)
