"""Token-id files by a static range asymmetric numeral system.

A file row is one segment: consecutive documents in id order, one frequency table for
all of its blocks, and the blocks. A block holds up to BLOCK_IDS ids coded over LANES
interleaved lanes and decodes without any other block; checkpoints inside it hold the
lanes' states and the place in the code, so a part of a block decodes without what
stands before. Each part between checkpoints has a checksum.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import as_bytes, map_batches, parts
from tickloom.llm.tokens import vocabulary, word_tokenizer

LANES = 1024
STEPS_PER_CHECKPOINT = 128
BLOCK_IDS = LANES * STEPS_PER_CHECKPOINT * 4
SEGMENT_IDS = BLOCK_IDS * 8
SCALE_BITS = 18
_LOW = np.uint64(1 << 31)
_WORD = np.uint64(32)
_BLOCK = pa.struct([("n", pa.int64()), ("code", pa.binary()), ("states", pa.binary()), ("places", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64()))])
_SEGMENT = pa.schema([("file", pa.int64()), ("segment", pa.int64()), ("n_ids", pa.int64()), ("symbols", pa.binary()), ("freqs", pa.binary()), ("blocks", pa.list_(_BLOCK)), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64()))])
SEGMENT_DDL = "file long, segment long, n_ids long, symbols binary, freqs binary, blocks array<struct<n long, code binary, states binary, places array<long>, sums array<long>>>, doc_ids array<long>, doc_tokens array<long>"


def quantised(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that add up to 2^bits in proportion to counts, each at least 1."""
    scale = 1 << bits
    if len(counts) > scale:
        raise ValueError("more symbols than the scale has slots")
    f = np.maximum(1, counts * scale // counts.sum()).astype(np.int64)
    spare = scale - int(f.sum())
    order = np.argsort(-f, kind="stable")
    while spare:
        for i in order if spare < 0 else order[:1]:
            change = spare if spare > 0 else -min(-spare, int(f[i]) // 2)
            f[i] += change
            spare -= change
            if not spare:
                break
    return f


class Table:
    def __init__(self, symbols: np.ndarray, freqs: np.ndarray) -> None:
        self.symbols = symbols.astype(np.uint16)
        self.f = freqs.astype(np.uint64)
        self.c = np.concatenate(([0], np.cumsum(self.f)[:-1])).astype(np.uint64)
        self.rank = np.zeros(1 << 16, np.int32)
        self.rank[self.symbols] = np.arange(len(symbols))
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.f), dtype=np.int32), self.f.astype(np.int64))
        return self._slots


def encode_block(ids: np.ndarray, table: Table) -> dict:
    n, bits = len(ids), np.uint64(SCALE_BITS)
    ranks = table.rank[ids]
    steps = -(-n // LANES)
    x = np.full(LANES, _LOW, np.uint64)
    chunks: list[np.ndarray] = []
    states: list[np.ndarray] = []
    lengths = np.zeros(steps, np.int64)
    for t in range(steps - 1, -1, -1):
        r = ranks[t * LANES : (t + 1) * LANES]
        f, c, lane = table.f[r], table.c[r], x[: len(r)]
        full = lane >= f << np.uint64(63 - SCALE_BITS)
        words = lane[full]
        chunks.append((words & np.uint64(0xFFFFFFFF)).astype("<u4"))
        lengths[t] = len(words)
        lane[full] = words >> _WORD
        quotient = lane // f
        x[: len(r)] = (quotient << bits) + (lane - quotient * f) + c
        if t % STEPS_PER_CHECKPOINT == 0:
            states.append(x.copy())
    begins = np.concatenate(([0], np.cumsum(lengths)))
    cuts = list(range(0, steps, STEPS_PER_CHECKPOINT))
    sums = [zlib.crc32(ids[t * LANES : (t + STEPS_PER_CHECKPOINT) * LANES].astype("<u2").tobytes()) for t in cuts]
    code = np.concatenate(chunks[::-1]) if chunks else np.zeros(0, "<u4")
    return {"n": n, "code": code.tobytes(), "states": np.concatenate(states[::-1]).astype("<u8").tobytes() if states else b"", "places": [int(begins[t]) for t in cuts], "sums": sums}


def decode_part(block: dict, table: Table, part: int) -> np.ndarray:
    """The ids between checkpoint `part` and the next, from that checkpoint alone."""
    n, mask, bits = block["n"], np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    code = np.frombuffer(block["code"], "<u4")
    x = np.frombuffer(block["states"], "<u8")[part * LANES : (part + 1) * LANES].astype(np.uint64)
    at, first = block["places"][part], part * STEPS_PER_CHECKPOINT * LANES
    out = np.empty(min(n - first, STEPS_PER_CHECKPOINT * LANES), np.int32)
    slots = table.slots
    for begin in range(0, len(out), LANES):
        lane = x[: min(LANES, len(out) - begin)]
        slot = lane & mask
        r = slots[slot.astype(np.int64)]
        out[begin : begin + len(lane)] = r
        lane[:] = table.f[r] * (lane >> bits) + slot - table.c[r]
        low = np.flatnonzero(lane < _LOW)
        lane[low] = (lane[low] << _WORD) | code[at : at + len(low)]
        at += len(low)
    ids = table.symbols[out]
    if zlib.crc32(ids.astype("<u2").tobytes()) != block["sums"][part]:
        raise ValueError(f"checksum of part {part} of a block does not match")
    return ids


def decode_block(block: dict, table: Table) -> np.ndarray:
    found = [decode_part(block, table, k) for k in range(len(block["places"]))]
    return np.concatenate(found) if found else np.zeros(0, np.uint16)


def encode_segment(ids: np.ndarray) -> dict:
    counts = np.bincount(ids, minlength=1)
    symbols = np.flatnonzero(counts)
    freqs = quantised(counts[symbols])
    table = Table(symbols, freqs)
    blocks = [encode_block(ids[k : k + BLOCK_IDS], table) for k in range(0, len(ids), BLOCK_IDS)]
    return {"n_ids": len(ids), "symbols": symbols.astype("<u2").tobytes(), "freqs": freqs.astype("<u4").tobytes(), "blocks": blocks}


def decode_segment(segment: dict) -> np.ndarray:
    table = Table(np.frombuffer(segment["symbols"], "<u2"), np.frombuffer(segment["freqs"], "<u4"))
    found = [decode_block(b, table) for b in segment["blocks"]]
    return np.concatenate(found) if found else np.zeros(0, np.uint16)


def write_ids(docs: DataFrame, to: str, path: str | None = None, end_id: int = 2, segment_ids: int = SEGMENT_IDS) -> None:
    """Encodes docs (doc_id, text) in ascending doc_id order and writes the segments to `to`.

    A null text is empty and has its end id only; rows of equal doc_id follow each other
    in order of a hash of the text; a null doc_id comes first; an empty table writes no
    segments. Range partitions by doc_id, that hash and a row number make the files, so
    file and segment numbers ascend with doc_id, rows of one id or of none fill several
    files, and a task holds one segment and the ids of one text, whatever its length.
    """
    path = path or vocabulary()
    order = ["doc_id", "hash", "row"]
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(max(1, 2 * parts(docs.sparkSession)), *order).sortWithinPartitions(*order)
    placed = ordered.select(F.spark_partition_id().cast("long").alias("file"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = word_tokenizer(path), np.array([end_id], "<u2").tobytes()
        file, number, held, docs_in, sizes = 0, 0, bytearray(), [], []

        def row() -> pa.RecordBatch:
            nonlocal number, held, docs_in, sizes
            made = encode_segment(np.frombuffer(bytes(held), "<u2")) | {"file": file, "segment": number, "doc_ids": docs_in, "doc_tokens": sizes}
            number, held, docs_in, sizes = number + 1, bytearray(), [], []
            return pa.RecordBatch.from_pylist([made], schema=_SEGMENT)

        for batch in batches:
            for f, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                file = f
                ids = tokenizer.encode(text) + end
                held += ids
                docs_in.append(doc)
                sizes.append(len(ids) // 2)
                if len(held) >= 2 * segment_ids:
                    yield row()
        if docs_in:
            yield row()

    placed.mapInArrow(run, SEGMENT_DDL).write.option("compression", "none").parquet(to)


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """One row for each document in the files: doc_id, start, n_tokens, ids_crc32 and, if asked, ids (32-bit little-endian).

    Each segment is decoded where it is read and its checksums are verified; only the
    number of ids of each segment is gathered, to find where segments start.
    """
    rows = spark.read.schema(SEGMENT_DDL).parquet(folder)
    earlier = F.coalesce(F.sum("held").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    files = rows.groupBy("file").agg(F.sum("n_ids").alias("held")).select("file", earlier.alias("first"))  # a row for each file
    inside = F.coalesce(F.sum("n_ids").over(W.partitionBy("file").orderBy("segment").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = rows.select("file", "segment", inside.alias("inside")).join(files, "file").select("file", "segment", (F.col("first") + F.col("inside")).alias("base"))
    ddl = "file long, segment long, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    names = [x.split()[0] for x in ddl.split(", ")]

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            for i in range(batch.num_rows):
                segment = batch.slice(i, 1).to_pylist()[0]
                ids = decode_segment(segment).astype("<u4")
                sizes = np.array(segment["doc_tokens"], np.int64)
                starts = np.cumsum(sizes) - sizes
                pieces = [ids[a : a + n].tobytes() for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                n = len(sizes)
                columns = [pa.array([segment["file"]] * n), pa.array([segment["segment"]] * n), pa.array(segment["doc_ids"], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(map(zlib.crc32, pieces), pa.int64()), *([pa.array(pieces, pa.binary())] if keep_ids else [])]
                yield pa.RecordBatch.from_arrays(columns, names)

        return each

    found = map_batches(rows, make, ddl)
    out = ["doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if keep_ids else [])]
    return found.join(begins, ["file", "segment"]).select(*out)
