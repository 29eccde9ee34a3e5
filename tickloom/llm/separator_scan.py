"""Token counts of documents from token files that do not tell where documents lie, by scanning for end-of-document ids.

Files are plain ones of 16-bit ids, or tables of blocks of them, as Spark writes and
reads in pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, as_bytes, map_batches, saved
from tickloom.llm.tokens import vocabulary, word_tokenizer

BLOCK_IDS = 1 << 18
#: No id of the vocabulary: its own end marker can stand in a text, so it ends no document.
END_ID = 0xFFFF


def write_flat(docs: DataFrame, to: str, path: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Writes token files: each task's texts one after another, each followed by end_id, as a table of numbered blocks of 16-bit ids.

    Spark has no writer of plain binary files, so blocks are rows of Parquet files; file and
    block number them in order, and nothing tells where documents lie. Blocks are cut at every block_ids ids wherever that falls in a document. A null text
    is empty. `doc_ids` is the writer's manifest, the documents whose end id lies in the
    block; a scan does not read it. Repeated rows and ids are documents each; an empty
    table writes no ids; other columns do not matter. An end_id of the vocabulary is refused.
    """
    path = path or vocabulary()
    kept = docs.select(F.spark_partition_id().cast("long").alias("file"), F.col("doc_id").cast("long"), "text")
    schema = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("ids", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = word_tokenizer(path), np.array([end_id], "<u2").tobytes()
        if tokenizer.tokenizer.id_to_token(end_id) is not None:
            raise ValueError(f"id {end_id} is in the vocabulary, so a text can hold it")
        size, file, block, held, pending = 2 * block_ids, 0, 0, bytearray(), []  # pending: (end in held, doc_id)

        def cut(n: int) -> pa.RecordBatch:
            nonlocal block, held, pending
            inside = [d for at, d in pending if at <= n]
            out = pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([bytes(held[:n])], pa.binary()), pa.array([inside], pa.list_(pa.int64()))], schema=schema)
            held, pending, block = held[n:], [(at - n, d) for at, d in pending if at > n], block + 1
            return out

        for batch in batches:
            for f, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                file = f
                held += tokenizer.encode(text) + end
                pending.append((len(held), doc))
                while len(held) >= size:
                    yield cut(size)
        if held:
            yield cut(len(held))

    kept.mapInArrow(run, "file long, block long, ids binary, doc_ids array<long>").write.option("compression", "zstd").parquet(to)


def scan(spark: SparkSession, folder: str, end_id: int = END_ID) -> DataFrame:
    """(file, block, n_ids, ends) of each block of write_flat(): how many ids it holds and where its end ids stand, found by one vector comparison."""

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            found = [np.frombuffer(x.as_buffer(), "<u2") for x in batch.column(2)]
            ends = [np.flatnonzero(ids == end_id) for ids in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array(ends, pa.list_(pa.int64()))], ["file", "block", "n_ids", "ends"])

        return each

    return map_batches(spark.read.parquet(folder).select("file", "block", "ids"), make, "file long, block long, n_ids long, ends array<long>")


def scan_plain(spark: SparkSession, folder: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> DataFrame:
    """The same of plain binary files of 16-bit little-endian ids, whatever wrote them; file is the path.

    Blocks are ranges of block_ids ids of a file; a last shorter one is a block too. Spark
    hands a file to a task whole, so memory is a small multiple of the largest file (2 GB
    at most); a file of odd length is refused, an empty one has no blocks.
    """

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                if len(content.as_buffer()) % 2:
                    raise ValueError(f"{path} does not hold 16-bit ids")
                ids = np.frombuffer(content.as_buffer(), "<u2")
                parts = [ids[k : k + block_ids] for k in range(0, len(ids), block_ids)]
                n = len(parts)
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()] * n, pa.string()), pa.array(range(n), pa.int64()), pa.array([len(x) for x in parts], pa.int64()), pa.array([np.flatnonzero(x == end_id) for x in parts], pa.list_(pa.int64()))], ["file", "block", "n_ids", "ends"])

        return each

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return map_batches(files, make, "file string, block long, n_ids long, ends array<long>")


def stitched(scanned: DataFrame) -> DataFrame:
    """One row for each document of scanned blocks, as a table: file, ordinal and start in the file, n_tokens with the end id, block and k, its end's place there.

    Blocks are scanned alone. What crosses their edges is stitched by a prefix scan over
    block summaries (ids and documents before a block, and where the last document
    before it ended); ends themselves do not pass through it. Ids after a file's last end
    id are no document.
    """
    with Scratch(scanned.sparkSession) as scratch:
        blocks = scratch.saved(scanned.withColumn("n_ends", F.size("ends").cast("long")), "scan")
        before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        at = blocks.select("file", "block", "n_ids", "n_ends", F.when(F.col("n_ends") > 0, F.element_at("ends", -1)).alias("last"))
        at = at.withColumns({"base": F.coalesce(F.sum("n_ids").over(before), F.lit(0)), "docs_before": F.coalesce(F.sum("n_ends").over(before), F.lit(0))})
        at = at.withColumn("open", F.coalesce(F.max(F.col("base") + F.col("last") + 1).over(before), F.lit(0))).where("n_ends > 0")
        each = blocks.select("file", "block", "ends").join(at.select("file", "block", "base", "docs_before", "open"), ["file", "block"]).select("*", F.posexplode("ends").alias("k", "end_at"))
        start = F.when(F.col("k") == 0, F.col("open")).otherwise(F.col("base") + F.element_at("ends", F.greatest(F.col("k"), F.lit(1))) + 1)
        return saved(each.select("file", "block", (F.col("docs_before") + F.col("k")).alias("ordinal"), F.col("k").cast("long").alias("k"), start.alias("start"), (F.col("base") + F.col("end_at") + 1 - start).alias("n_tokens")), "counts")


def token_counts(spark: SparkSession, folder: str, end_id: int = END_ID) -> DataFrame:
    """stitched() of the files of write_flat()."""
    return stitched(scan(spark, folder, end_id))


def named(spark: SparkSession, folder: str, counts: DataFrame) -> DataFrame:
    """Adds the manifest's doc_id to what the scan found."""
    manifest = spark.read.parquet(folder).select("file", "block", F.posexplode("doc_ids").alias("k", "doc_id")).withColumn("k", F.col("k").cast("long"))
    return counts.join(manifest, ["file", "block", "k"], "left").drop("k", "block")
