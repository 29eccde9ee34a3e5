"""Scoring of whole documents by a gated recurrent language model that is trained on the corpus itself.

Counts of all training tokens come first; then every text is read once more and kept as
16-bit symbols, from which the network is trained and scores. Training runs in rounds
over disjoint parts of all training documents: every task trains a copy of the network on its documents, copies
are averaged by weight of their tokens, and the mean starts the next round. Scoring
carries the state through each whole text. Words outside the listed vocabulary get
their counts by a join, so no task holds all words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import gated
from tickloom.llm.common import Scratch, map_batches, saved

#: Words whose counts every task holds, at most: the most frequent ones.
LISTED = 200_000
#: Counts of words that a task holds before it adds them up, and bytes of text that are split into words at once.
HELD_WORDS, CHUNK = 1_000_000, 1 << 23
#: Tokens that a task streams at once; longer streams have more lanes beside a long text.
STREAM_TOKENS = 4_000_000
RATES = (0.01, 0.006, 0.003)
SLICES, FANS = 32, 64
_KIND = np.full(256, 3)  # of a last byte: letter 0, mark 1, digit 2, other 3
_KIND[128:], _KIND[97:123], _KIND[48:58], _KIND[list(b",.;:!?")] = 0, 0, 2, 1
_vocabularies: dict[int, Vocabulary] = {}


def shape_classes(words: pa.Array | Sequence[bytes]) -> np.ndarray:
    """The tail class of each word: kind of its last byte, length, and whether it is all ASCII."""
    words = words if isinstance(words, pa.Array) else pa.array(words, pa.binary()).cast(pa.string())
    if not len(words):
        return np.zeros(0, np.int32)
    _, ends, data = words.buffers()
    last = np.frombuffer(data, np.uint8)[np.frombuffer(ends, np.int32)[words.offset + 1 : words.offset + len(words) + 1] - 1]
    size = pc.binary_length(words).to_numpy()
    ascii_ = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
    return ((_KIND[last] * 4 + np.searchsorted([4, 7, 10], size)) * 2 + ~ascii_).astype(np.int32)


def split_words(texts: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """Runs of neighbouring texts of about CHUNK bytes (one text at least): number of the first, all words, A-Z lower-cased, and how many each text has."""
    texts = texts.cast(pa.large_string()).fill_null("")
    held = np.cumsum(pc.binary_length(texts).to_numpy())
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(held, (held[begin - 1] if begin else 0) + CHUNK, side="right")))
        own = texts.take(pa.array(np.arange(begin, end))).cast(pa.string())  # a copy: ascii_lower misreads slices
        lists = pc.ascii_split_whitespace(pc.ascii_lower(own))
        words, n = lists.flatten(), pc.list_value_length(lists).to_numpy()
        real = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty word there
        n = np.bincount(np.repeat(np.arange(len(n)), n), real.to_numpy(zero_copy_only=False), len(n)).astype(np.int64)
        yield begin, words.filter(real), n
        begin = end


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 10 == 0


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, cls, n) of every word of texts (text), A-Z lower-cased."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def rows(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in table.to_batches():
                yield pa.RecordBatch.from_arrays([b["word"], pa.array(shape_classes(b["word"])), b["n"]], ["word", "cls", "n"])

        for batch in batches:
            for _, words, _ in split_words(batch.column(0)):
                counts = words.value_counts()
                held.append(pa.table({"word": counts.field("values"), "n": counts.field("counts")}))
                if sum(map(len, held)) > HELD_WORDS:
                    held = [merged()]
                    if len(held[0]) > HELD_WORDS // 2:
                        yield from rows(held.pop())
        if held:
            yield from rows(merged())

    return texts.select("text").mapInArrow(run, "word string, cls int, n long").groupBy("word", "cls").agg(F.sum("n").alias("n"))


@dataclass
class Listing:
    """What every task knows: the listed words in descending count, their counts, and sums over all words."""

    words: pa.Array
    counts: np.ndarray
    ends: int
    tokens: int
    distinct: int
    tail_masses: np.ndarray  # of words outside the head: counts + 0.1 * (words + 1), by class


class Vocabulary:
    """Numbers of words: head words have a place in a head class, all others a tail class. The end symbol is place 0."""

    def __init__(self, listing: Listing) -> None:
        self.listing, head = listing, min(len(listing.words), gated.HEAD - 1)
        self.symbol = np.arange(len(listing.words) + 1, dtype=np.int32)
        self.symbol[head + 1 :] = gated.HEAD + shape_classes(listing.words[head:])
        self.log_count = np.log10(np.concatenate(([listing.ends], listing.counts)) + 0.1)
        self.log_tail = np.log10(listing.tail_masses)
        self.log_base = float(np.log10(listing.tokens + 0.1 * (listing.distinct + 1)))

    def read(self, words: pa.Array, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]:
        """Of texts of n words each: every token's text, listed number (-1: none) and symbol, end symbols included, and each text's unlisted words, each once with its number there."""
        doc = np.repeat(np.arange(len(n)), n + 1)
        word = np.ones(len(doc), bool)
        word[np.cumsum(n + 1) - 1] = False
        found = pc.index_in(words, value_set=self.listing.words).fill_null(-2).to_numpy()
        numbers = np.zeros(len(doc), np.int32)
        numbers[word] = np.maximum(found + 1, -1)
        symbols, at = self.symbol[numbers], np.flatnonzero(numbers < 0)
        unlisted = words.filter(pa.array(found < 0))
        symbols[at] = gated.HEAD + shape_classes(unlisted)
        rare = pa.table({"doc": doc[at], "word": unlisted}).group_by(["doc", "word"], use_threads=False).aggregate([([], "count_all")]).sort_by("doc")
        starts = np.searchsorted(rare["doc"].to_numpy(), np.arange(len(n) + 1)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([_one(rare["word"]), _one(rare["count_all"])], ["word", "times"])
        return doc, numbers, symbols, pa.ListArray.from_arrays(pa.array(starts), pairs)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def vocabulary(listing: Broadcast) -> Vocabulary:
    """One for each Python worker and broadcast."""
    key = id(listing.value)
    if key not in _vocabularies:
        _vocabularies.clear()
        _vocabularies[key] = Vocabulary(listing.value)
    return _vocabularies[key]


def list_words(counts: DataFrame, ends: int) -> Listing:
    """The listing from all counts; words of the least listed count are all in or all out, so at most LISTED rows reach the driver."""
    sums = counts.agg(F.sum("n"), F.count("*")).first()
    by_count = counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n"))
    least, held = 1 << 62, 0
    for row in by_count.toLocalIterator():
        if held + row.words > LISTED:
            break
        least, held = row.n, held + row.words
    top = counts.where(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True], kind="stable")
    words = pa.array(top["word"], pa.string())
    masses = np.full(gated.TAIL_CLASSES, 0.1)
    for row in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        masses[row.cls] += row.n + 0.1 * row.v
    head = words[: gated.HEAD - 1]
    np.subtract.at(masses, shape_classes(head), top["n"].to_numpy(float)[: len(head)] + 0.1)
    return Listing(words, top["n"].to_numpy(np.int64), ends, (sums[0] or 0) + ends, sums[1] + (ends > 0), np.maximum(masses, 0.1))


def _streams(read: Iterator[tuple[object, np.ndarray]]) -> Iterator[list[tuple[object, np.ndarray]]]:
    held, size = [], 0
    for item in read:
        held.append(item)
        size += len(item[1])
        if size >= STREAM_TOKENS:
            yield held
            held, size = [], 0
    if held:
        yield held


def train_round(streams: DataFrame, params: np.ndarray, rate: float) -> np.ndarray:
    """The token-weighted mean of the networks that the tasks of streams (symbols) trained from params."""
    start = streams.sparkSession.sparkContext.broadcast(params)
    size = -(-len(params) // SLICES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, tokens = gated.Network(gated.unflat(start.value), 0), 0
        read = ((None, symbols) for batch in batches for symbols in _symbols(batch.column(0)))
        for docs in _streams(read):
            network.stream([d for _, d in docs], rate)
            tokens += sum(len(d) for _, d in docs)
        if tokens:
            v, who = gated.flat(network.p), TaskContext.get().partitionId()
            pieces = [v[k * size : (k + 1) * size].tobytes() for k in range(SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([who] * SLICES, pa.int32()), pa.array([tokens] * SLICES, pa.int64()), pa.array(pieces, pa.binary())], ["slice", "who", "tokens", "v"])

    def mean(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("who")
        weights = rows["tokens"].to_numpy(float)
        v = sum(w * np.frombuffer(x, np.float32).astype(float) for w, x in zip(weights / weights.sum(), rows["v"], strict=True))
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "who": rows["who"].iloc[:1], "tokens": [int(weights.sum())], "v": [v.astype(np.float32).tobytes()]})

    schema = "slice int, who int, tokens long, v binary"
    made = streams.select("symbols").mapInArrow(run, schema)
    made = made.groupBy("slice", F.pmod("who", F.lit(FANS)).alias("fan")).applyInPandas(mean, schema).groupBy("slice").applyInPandas(mean, schema)
    found = {row.slice: row.v for row in made.collect()}
    start.unpersist()
    return np.concatenate([np.frombuffer(found[k], np.float32) for k in range(SLICES)]) if found else params


def _symbols(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u2").astype(np.int32) for x in column.to_pylist()]


def encoded(docs: DataFrame, listing: Broadcast) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base, inside, symbols and rare of every row of docs.

    base is the log10 probability of the listed tokens under the counts, inside what the
    listed tail words have inside their classes; rare holds the other words, each once
    with its number in the text.
    """
    ddl = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, inside double, symbols binary, rare array<struct<word string, times long>>"
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "inside", "symbols", "rare"]

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        words = vocabulary(listing)

        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            for begin, split, n in split_words(batch.column(3)):
                doc, numbers, symbols, rare = words.read(split, n)
                listed, tail = numbers >= 0, symbols >= gated.HEAD
                log_count = np.where(listed, words.log_count[numbers], 0.0)
                known = listed & ((numbers > 0) | (words.listing.ends > 0))
                base = np.bincount(doc, log_count, len(n)) - (n + 1) * words.log_base
                inside = np.bincount(doc, np.where(tail, log_count - words.log_tail[np.where(tail, symbols - gated.HEAD, 0)], 0.0), len(n))
                own = [batch.column(k).slice(begin, len(n)) for k in range(3)]
                ends = np.concatenate(([0], np.cumsum(n + 1))).astype(np.int32) * 2
                held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(symbols.astype("<u2"))])
                yield pa.RecordBatch.from_arrays([*own, pa.array(n + 1), pa.array(np.bincount(doc, known, len(n)).astype(np.int64)), pa.array(base), pa.array(inside), held, rare], names)

        return each

    kept = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(kept, make, ddl)


def network_scores(streams: DataFrame, params: Broadcast) -> DataFrame:
    """(row, logs): log10 probability of each row's symbols under the network, its state carried through the whole text."""

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        network = gated.Network(gated.unflat(params.value), 0)

        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            for docs in _streams(zip(batch.column(0).to_pylist(), _symbols(batch.column(1)), strict=True)):
                logs = network.stream([x for _, x in docs]) / np.log(10)
                yield pa.RecordBatch.from_arrays([pa.array([row for row, _ in docs], pa.int64()), pa.array(logs)], ["row", "logs"])

        return each

    return map_batches(streams.select("row", "symbols"), make, "row long, logs double")


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs (doc_id, text).

    A null or empty text is its end symbol alone. A null doc_id counts as held out. Rows
    of equal doc_id, and repeated rows, are scored each by its own text; without training
    documents the model stays as it started; an empty table gives no rows; other columns
    do not matter. score is the log10 probability of the whole text under the model.

    Each task trains a replica on the rows that it reads, so another split of the input
    into tasks gives a slightly different model; counts and base_score do not depend on
    it. A lane learns from whole documents one after another; small tasks take fewer
    lanes, so that a small corpus gets enough updates.
    """
    context = docs.sparkSession.sparkContext
    with Scratch(docs.sparkSession) as scratch:
        train = docs.where(~held_out(F.col("doc_id")))
        counts = scratch.saved(word_counts(train), "counts")
        listing = list_words(counts, train.count())
        head = np.zeros(gated.HEAD)
        head[0] = listing.ends
        head[1 : len(listing.counts[: gated.HEAD - 1]) + 1] = listing.counts[: gated.HEAD - 1]
        params = gated.flat(gated.initial(head, listing.tail_masses))
        rows = scratch.saved(encoded(docs, context.broadcast(listing)), "symbols")
        for k, rate in enumerate(RATES):
            part = rows.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id"), F.lit(len(RATES))) == k))
            params = train_round(part, params, rate)
        logs = network_scores(rows, context.broadcast(params))
        rare = rows.select("row", F.explode("rare").alias("x")).select("row", "x.*").join(counts.select("word", "n"), "word", "left")
        rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"))
        out, more = rows.drop("rare", "symbols").join(logs, "row").join(rare, "row", "left"), F.coalesce("more", F.lit(0.0))
        return saved(out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(listing.tokens).cast("long").alias("train_tokens"), (F.col("base") + more).alias("base_score"), (F.col("logs") + F.col("inside") + more).alias("score")), "scores")
