"""Ranked lexical search: documents are grouped by the mask of an item's terms they hold, and masks are evaluated by descending bound.

A task holds a block of documents as one bitmap for each term of the items. For an item,
the bitmaps of its terms, turned over, give every document's mask of matched terms;
documents of equal mask are one group, whose bound is the sum of what its terms can
give at most in this block. Groups are scored exactly in order of their bounds, until no
bound reaches the k-th best score that the task has seen.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, as_bytes, map_batches, saved

#: Bytes of terms: digits, letters and all of UTF-8 beyond ASCII; A-Z become a-z, all else a blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Items, and different terms of them, that one pass over the documents ranks for, at most; an item of more terms has a pass of its own.
ITEMS_AT_ONCE, TERMS_AT_ONCE = 1024, 50_000
#: Documents of the first groups that are scored for an item in a block; later runs grow by this factor's square root.
FIRST_DOCS = 64
#: A long text is cut into about so many bytes at a blank while its terms are counted.
PIECE_BYTES = 1 << 20


def pieces_of(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a whole text, in runs of bounded size."""
    clean, at = text.translate(_TERMS), 0
    while len(clean) - at > PIECE_BYTES:
        cut = clean.find(b" ", at + PIECE_BYTES)
        if cut < 0:
            break
        yield clean[at:cut].split()
        at = cut
    yield clean[at:].split()


@dataclass
class Item:
    number: int
    terms: np.ndarray  # numbers in the block's vocabulary
    repeats: np.ndarray


def item_blocks(items: DataFrame) -> Iterator[tuple[list[tuple], list[Item], dict[bytes, int]]]:
    """(keys, items, vocabulary) of items (key, text) in blocks of bounded size; items without terms are left out."""
    keys: list[tuple] = []
    listed: list[Item] = []
    vocabulary: dict[bytes, int] = {}
    for key, text in items.toLocalIterator():
        times: Counter[bytes] = Counter()
        for run in pieces_of((text or "").encode()):
            times.update(run)
        if not times:
            continue
        if listed and (len(listed) == ITEMS_AT_ONCE or len(vocabulary) + len(times) > TERMS_AT_ONCE):
            yield keys, listed, vocabulary
            keys, listed, vocabulary = [], [], {}
        numbers = [vocabulary.setdefault(t, len(vocabulary)) for t in times]
        keys.append((len(listed), key))
        listed.append(Item(len(listed), np.array(numbers, np.int64), np.array(list(times.values()), np.int64)))
    if listed:
        yield keys, listed, vocabulary


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times) of each document with a term: all its terms with repeats, and which of the vocabulary it holds how often."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        number = known.value.get

        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            sizes, owner, found = [], [], []
            for i, text in enumerate(as_bytes(batch.column(1))):
                n = 0
                for run in pieces_of(text):
                    n += len(run)
                    held = np.array([x for x in map(number, run) if x is not None], np.int64)
                    if len(run) > PIECE_BYTES // 64:  # of a long text each run is counted at once
                        held, times = np.unique(held, return_counts=True)
                        found.append((held, times))
                    else:
                        found.append((held, np.ones(len(held), np.int64)))
                    owner.append(np.full(len(held), i, np.int64))
                sizes.append(n)
            at = np.concatenate(owner) << 32 | np.concatenate([x for x, _ in found])
            pairs, back = np.unique(at, return_inverse=True)
            times = np.bincount(back, weights=np.concatenate([t for _, t in found]), minlength=len(pairs)).astype("<u4")
            terms, bounds = (pairs & 0xFFFFFFFF).astype("<u4"), np.searchsorted(pairs >> 32, np.arange(len(sizes) + 1))
            keep = [i for i, n in enumerate(sizes) if n]
            cut = lambda x: pa.array([x[bounds[i] : bounds[i + 1]].tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([sizes[i] for i in keep], pa.int64()), cut(terms), cut(times)], ["doc_id", "n", "terms", "times"])

        return each

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n long, terms binary, times binary")


def statistics(held: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """Documents, all their terms, and the documents that hold each term of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        has = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(total[has])], ["term", "df"])

    docs, words = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(size, np.int64)
    for term, n in held.select("terms").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df")).collect():
        df[term] = n
    return docs, words, df


def term_weights(docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


class Block:
    """Documents with the bitmaps of the terms they hold."""

    def __init__(self, ids: np.ndarray, blank: np.ndarray, n: np.ndarray, terms: np.ndarray, times: np.ndarray, owner: np.ndarray, docs: int, words: int) -> None:
        self.ids, self.blank, self.size = ids, blank, len(ids)
        m = 75 + 25 * n * docs // words
        order = np.argsort(terms, kind="stable")
        self.owner, times = owner[order], times[order]
        self.terms, first, count = np.unique(terms[order], return_index=True, return_counts=True)
        self.first, self.end = first, first + count
        self.part = 1_000_000_000 * times // (1000 * times + 12 * m[self.owner])
        most = np.maximum.reduceat(times, first) if len(first) else times
        self.bound = (1_000_000_000 * most // (1000 * most + 12 * (m.min() if len(m) else 1))).astype(np.float64)
        wide = -(-self.size // 8)
        self.bitmaps = np.zeros((len(self.terms), wide), np.uint8)
        which = np.repeat(np.arange(len(self.terms)), count)
        for a in range(0, len(self.terms), 512):  # bounds the plain bits at hand
            inside = slice(first[a], self.end[min(a + 512, len(self.terms)) - 1])
            bits = np.zeros((min(512, len(self.terms) - a), self.size), np.uint8)
            bits[which[inside] - a, self.owner[inside]] = 1
            self.bitmaps[a : a + len(bits)] = np.packbits(bits, axis=1)

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents with any of these terms in groups of equal mask: bits of each mask (mask, term), and each document's mask or -1."""
        some = self.bitmaps[rows]
        hit = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(some, axis=0), count=self.size))
        turned = np.packbits(np.unpackbits(some, axis=1, count=self.size)[:, hit], axis=0)
        words = np.zeros((len(hit), -(-len(turned) // 8) * 8), np.uint8)
        words[:, : len(turned)] = turned.T
        words = words.view(np.uint64)
        order = np.lexsort(words.T)
        new = np.ones(len(hit), bool)
        new[1:] = (words[order][1:] != words[order][:-1]).any(axis=1)
        of = np.full(self.size, -1, np.int64)
        of[hit[order]] = np.cumsum(new) - 1
        bits = np.unpackbits(turned.T[order[new]], axis=1, count=len(rows))
        return bits, of

    def scores(self, rows: np.ndarray, weights: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Exact scores of the chosen documents."""
        total = np.zeros(self.size, np.int64)
        for row, weight in zip(rows.tolist(), weights.tolist(), strict=True):
            at = slice(self.first[row], self.end[row])
            docs = self.owner[at]
            inside = chosen[docs]
            total[docs[inside]] += weight * self.part[at][inside]
        return total


class Best:
    """The k best documents of an item so far: highest score, then least id, null ids last."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id, self.blank = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def least(self) -> int:
        """A score under this one can't be among the best."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, blank: np.ndarray) -> None:
        score, ids, blank = np.concatenate((self.score, score)), np.concatenate((self.id, ids)), np.concatenate((self.blank, blank))
        order = np.lexsort((ids, blank, -score))[: self.k]
        self.score, self.id, self.blank = score[order], ids[order], blank[order]


def search_block(block: Block, item: Item, weights: np.ndarray, best: Best) -> int:
    """Brings best up to date with the block; returns how many documents it scored."""
    at = np.searchsorted(block.terms, item.terms)
    there = at < len(block.terms)
    there[there] = block.terms[at[there]] == item.terms[there]
    rows, w = at[there], (weights[item.terms] * item.repeats)[there]
    if not len(rows):
        return 0
    bits, of = block.masks(rows)
    bound = bits @ (w * block.bound[rows]) * (1 + 1e-9) + 1  # sums of doubles, so a little more
    docs = np.bincount(of[of >= 0], minlength=len(bits))
    order = np.argsort(-bound, kind="stable")
    filled, begin, run, scored = np.cumsum(docs[order]), 0, FIRST_DOCS, 0
    while begin < len(order) and bound[order[begin]] >= best.least():
        end = min(max(begin + 1, int(np.searchsorted(filled, scored + run, "right"))), len(order))
        wanted = order[begin:end]
        wanted = wanted[bound[wanted] >= best.least()]
        take = np.zeros(len(bits) + 1, bool)  # the last stands for no mask
        take[wanted] = True
        chosen = take[of]
        total = block.scores(rows, w, chosen)
        good = np.flatnonzero(total >= best.least())
        best.add(total[good], block.ids[good], block.blank[good])
        scored, begin, run = int(filled[end - 1]), end, run * 8
    return scored


def ranked(held: DataFrame, items: list[Item], weights: np.ndarray, docs: int, words: int, k: int) -> DataFrame:
    """(item, doc_id, score): each item's k best documents of every task."""
    known = held.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, w = known.value
        best = [Best(k) for _ in listed]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, n, terms, times = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            owner = np.repeat(np.arange(len(terms)), [len(x) // 4 for x in terms])
            block = Block(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), n, np.frombuffer(b"".join(terms), "<u4").astype(np.int64), np.frombuffer(b"".join(times), "<u4").astype(np.int64), owner, docs, words)
            for item, one in zip(listed, best, strict=True):
                search_block(block, item, w, one)
        got = [(item.number, one) for item, one in zip(listed, best, strict=True) if len(one.score)]
        if got:
            number = np.concatenate([np.full(len(one.score), i, np.int64) for i, one in got])
            ids = pa.array(np.concatenate([one.id for _, one in got]), pa.int64(), mask=np.concatenate([one.blank for _, one in got]))
            yield pa.RecordBatch.from_arrays([pa.array(number), ids, pa.array(np.concatenate([one.score for _, one in got]))], ["item", "doc_id", "score"])

    return held.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc: str = "doc_id", key: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of docs (doc_id, text) for each row of items (item_id, text).

    Equal scores go by ascending doc_id, null ids last; rows of equal id are ranked each
    on its own, and so are items of equal or null id. Null, empty and blank texts have no
    terms, so such documents count nowhere and such items have no rows; empty tables give
    no rows. Other columns are not read. Texts of any length are counted whole, in runs of
    a megabyte. Items go through the driver in blocks of at most ITEMS_AT_ONCE items or
    TERMS_AT_ONCE terms, and each block reads the documents once; what a task holds is one
    batch of documents with a bitmap for each term, and k rows for each item.
    """
    d = docs.select(F.col(doc).cast("long").alias("doc_id"), "text")
    kind = items.schema[key].dataType.simpleString()
    out = None
    with Scratch(docs.sparkSession) as scratch:
        for keys, listed, vocabulary in item_blocks(items.select(key, "text")):
            held = scratch.saved(postings(d, vocabulary), "postings")
            n, words, df = statistics(held, len(vocabulary))
            found = ranked(held, listed, term_weights(n, df), n, words, k)
            place = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
            top = found.withColumn("rank", place).where(F.col("rank") <= k)
            names = docs.sparkSession.createDataFrame(keys, f"item long, item_id {kind}")
            part = scratch.saved(top.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")
            out = part if out is None else out.unionByName(part)
        if out is None:
            return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
        return saved(out, "search")
