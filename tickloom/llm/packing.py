"""Packing by minimum bin slack: each window takes the multiset of remaining lengths that fills it best.

A document longer than a window is cut into full windows and one remainder. Remainders
are dealt by hash into groups of bounded size; a group fills window after window with a
subset-sum dynamic programme over the lengths it has left, held as one bitset.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import as_bytes, map_batches, saved
from tickloom.llm.tokens import vocabulary, word_tokenizer

#: Remainders that one group packs, on average.
GROUP_ROWS = 8192


def best_fill(counts: np.ndarray, capacity: int, seed: int) -> list[tuple[int, int]]:
    """(length, times) of the window that holds `seed` and comes closest to capacity, by backtracking over bitsets.

    counts[length] is what is left, the seed included. Bit s of a bitset says that the
    lengths seen so far can add up to s; a length that occurs c times enters in parts of
    1, 2, 4, ... so that its cost is logarithmic in c.
    """
    room = capacity - seed
    full, mask = 1 << room, (1 << (room + 1)) - 1
    bits, steps = 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        left = int(counts[length]) - (length == seed)
        left = min(left, room // length)
        part = 1
        while left > 0:
            take = min(part, left)
            steps.append((bits, length, take))
            bits |= (bits << (length * take)) & mask
            left -= take
            part *= 2
        if bits & full:
            break
    total = bits.bit_length() - 1
    taken = {seed: 1}
    for before, length, take in reversed(steps):
        if not (before >> total) & 1:
            total -= length * take
            taken[length] = taken.get(length, 0) + take
    return list(taken.items())


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each length; the longest that is left seeds each window."""
    order = np.argsort(-lengths, kind="stable")
    by_length: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        by_length.setdefault(int(lengths[i]), []).append(i)
    counts = np.bincount(lengths, minlength=capacity + 1)
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    seed, number = capacity, 0
    while True:
        while seed > 0 and not counts[seed]:
            seed -= 1
        if seed <= 0:
            return window, offset
        at = 0
        for length, times in best_fill(counts, capacity, seed):
            counts[length] -= times
            for _ in range(times):
                i = by_length[length].pop()
                window[i], offset[i] = number, at
                at += length
        number += 1


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """Pieces of each whole text's ids and one end id: full windows and a remainder, with checksums and, if asked, the ids."""
    schema = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    kept = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text"))

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        tokenizer, end = word_tokenizer(path), np.array([end_id], "<u2").tobytes()

        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            out: list[tuple] = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                ids = np.frombuffer(tokenizer.encode(text) + end, "<u2").astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity].tobytes()
                    out.append((doc, row, start, len(piece) // 4, zlib.crc32(piece), len(ids), *([piece] if keep_ids else [])))
            types = [pa.int64()] * 6 + [pa.binary()] * keep_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

        return each

    names = [x.split()[0] for x in schema.split(", ")]
    return map_batches(kept, make, schema)


def pack(docs: DataFrame, path: str | None = None, end_id: int = 1, capacity: int = 2048, group_rows: int = GROUP_ROWS, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each row of docs (doc_id, text): which ids it holds, and its sequence and offset there.

    A null or empty text is its end id alone; rows of equal doc_id are packed each on
    its own; an empty table gives no rows; a text of any length is tokenised whole, with
    its ids, two bytes each, in memory, and cut into windows. Sequences come out the same
    for the same input files. A group is one task's work of about group_rows remainders, whatever
    the lengths, so the pad at a group's end is under one window in thousands.
    """
    pieces = saved(token_pieces(docs, path or vocabulary(), end_id, capacity, keep_ids=keep_ids), "pieces")
    narrow = pieces.select("doc_id", "row", "start", "length")
    groups = max(1, -(-narrow.count() // group_rows))
    dealt = narrow.withColumn("grp", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(groups)))

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "row", "start"], kind="stable")
        window, offset = pack_lengths(rows["length"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"row": rows["row"], "start": rows["start"], "sequence_id": rows["grp"].to_numpy(np.int64) * (1 << 28) + window, "offset": offset})

    placed = dealt.groupBy("grp").applyInPandas(pack_group, "row long, start long, sequence_id long, offset long")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * keep_ids]
    return pieces.join(placed, ["row", "start"]).select(columns)
