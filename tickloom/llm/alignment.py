"""Alignment of two tokenizers: where tokens of both end at the same byte, found by a merge path.

The ends of A's and of B's tokens are two ascending lists. Diagonals of their merge
grid, each met by a binary search, cut the merge into independent pieces of equal work,
however the tokens lie. A piece emits the ends that both lists have in it; an equal pair
that a diagonal parts is put back when pieces are joined, and what lies between two
common ends is a group.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, file_row, map_batches, saved
from tickloom.llm.tokens import vocabulary

#: Ends of tokens, of A and B together, that one piece of the merge holds.
PIECE = 1 << 16
#: A text is tokenised in runs of about so many characters, cut at a blank between two word characters, which no token crosses.
RUN_CHARS = 1 << 20
#: Pairs whose counts every task holds, the most frequent ones; the rest get theirs by a join.
LISTED = 1_000_000
#: Different pairs that a task adds up before it hands them on.
HELD = 4_000_000
_CUT = re.compile(r"(?<=\w) (?=\w)")
#: Latin letters and signs, for which both libraries of the byte-level tokenizer split words alike.
_PLAIN = re.compile("[\\x00-\u024f\u2010-\u2027\u20ac]*")
_memo: dict[tuple[str, str, str | None], Tokenizers] = {}


class Tokenizers:
    """A byte-level tokenizer A, which takes space+text, and a piece tokenizer B, which adds the space itself, with the bytes of their tokens.

    ranks names the file of A's vocabulary for a second, faster library, which encodes
    texts of Latin letters; its ids are the same.
    """

    def __init__(self, a: str, b: str, ranks: str | None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b, self.fast = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b), None
        self.a.encode_special_tokens = True
        words = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if max(len(words), len(pieces)) > 1 << 16:
            raise ValueError("ids of these vocabularies do not fit 16 bits")
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                known = {base64.b64decode(x): int(i) for x, i in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c and c != 173]
        byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}
        self.a_bytes = [bytes(map(byte.__getitem__, w)) if all(c in byte for c in w) else w.encode() for w, _ in words]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        own = [str(i) for i in range(1 << 16)]
        self.shown = np.array([x + mark for mark in ",|,;" for x in own], object)
        # A piece with a blank after another character would let B's tokens cross a cut.
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def runs(self, text: str) -> list[str]:
        """A text in runs: space+text is the runs, each after a space."""
        out, at = [], 0
        while self.cuts and len(text) - at > RUN_CHARS:
            cut = _CUT.search(text, at + RUN_CHARS)
            if cut is None:
                break
            out.append(text[at : cut.start()])
            at = cut.end()
        return [*out, text[at:]]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; both empty where their bytes are not those of space+text."""
        out = []
        for text in texts:
            a, b = [], []
            for run in self.runs(text) if text else []:
                spaced = " " + run
                x = self.fast.encode_ordinary(spaced) if self.fast and _PLAIN.fullmatch(run) else self.a.encode(spaced, add_special_tokens=False).ids
                y = self.b.encode(run)
                want = spaced.encode()
                if b"".join(map(self.a_bytes.__getitem__, x)) != want or b"".join(map(self.b_bytes.__getitem__, y)) != want:
                    a, b = [], []
                    break
                a.append(np.array(x, np.int64))
                b.append(np.array(y, np.int64))
            none = [np.zeros(0, np.int64)]
            out.append((np.concatenate(a or none), np.concatenate(b or none)))
        return out


def tokenizers(a: str, b: str, ranks: str | None) -> Tokenizers:
    """One for each Python worker and files."""
    if (a, b, ranks) not in _memo:
        _memo[a, b, ranks] = Tokenizers(a, b, ranks)
    return _memo[a, b, ranks]


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the ascending ends a lie before each diagonal of the merge with b, a first among equals: one binary search for each, all at once."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while len(open_ := np.flatnonzero(low < high)):
        mid = (low[open_] + high[open_]) // 2
        more = a[mid] <= b[diagonals[open_] - 1 - mid]
        low[open_] = np.where(more, mid + 1, low[open_])
        high[open_] = np.where(more, high[open_], mid)
    return low


def common_ends(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both have; each strictly ascends. Pieces of the merge are worked on alone and then joined."""
    total = len(a) + len(b)
    cuts = np.append(np.arange(0, total, piece), total)
    of_a = merge_path(a, b, cuts)
    of_b = cuts - of_a
    left, right = [], []
    for i0, i1, j0, j1 in zip(of_a[:-1].tolist(), of_a[1:].tolist(), of_b[:-1].tolist(), of_b[1:].tolist(), strict=True):
        at = np.searchsorted(b[j0:j1], a[i0:i1])
        inside = np.flatnonzero(at < j1 - j0)
        same = inside[b[j0 + at[inside]] == a[i0 + inside]]
        left.append(i0 + same)
        right.append(j0 + at[same])
        if i1 > i0 and j1 < len(b) and a[i1 - 1] == b[j1]:  # the diagonal parts an equal pair: its end of b opens the next piece
            left.append(np.array([i1 - 1]))
            right.append(np.array([j1]))
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def aligned(ids: list[tuple[np.ndarray, np.ndarray]], shown: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
    """(n_a, n_b, n_groups, groups, pairs, times) of each text of a batch, whose tokens are merged as one pair of lists."""
    none = [np.zeros(0, np.int64)]
    a, b = np.concatenate([x for x, _ in ids] or none), np.concatenate([y for _, y in ids] or none)
    i, j = common_ends(np.cumsum(a_sizes[a]), np.cumsum(b_sizes[b]), piece)
    # Tokens in order of group, A's before B's: one of A comes after the ends of b in groups before, one of B after those of a up to its group.
    a_group, b_group = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
    text = np.zeros(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[i], last_b[j] = True, True
    text[np.arange(len(a)) + np.append(0, j + 1)[a_group]] = a + (last_a << 16)
    text[np.arange(len(b)) + np.append(i + 1, len(a))[b_group]] = b + (1 << 17) + (last_b << 16)
    strings, pairs = shown[text].tolist(), a[i] << 16 | b[j]
    a_end, b_end = np.cumsum([0, *(len(x) for x, _ in ids)]), np.cumsum([0, *(len(y) for _, y in ids)])
    link = np.searchsorted(i, a_end)
    owner = np.repeat(np.arange(len(ids)), np.diff(link))
    keys, times = np.unique(owner << 32 | pairs, return_counts=True)
    at = np.searchsorted(keys >> 32, np.arange(len(ids) + 1))
    for k in range(len(ids)):
        groups = "".join(strings[a_end[k] + b_end[k] : a_end[k + 1] + b_end[k + 1]])[:-1]
        part = slice(at[k], at[k + 1])
        yield int(a_end[k + 1] - a_end[k]), int(b_end[k + 1] - b_end[k]), int(link[k + 1] - link[k]), groups, (keys[part] & 0xFFFFFFFF).astype("<u4"), times[part].astype("<u4")


def align(docs: DataFrame, a: str, b: str, ranks: str | None = None, doc: str = "doc_id", keep_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each row of docs: its alignment, and the id pairs a << 16 | b it links, as 32-bit integers, with how often.

    keep_groups adds the groups themselves, `a1,a2|b1;a3|b2,b3`. Every token has a byte at
    least, so ends ascend strictly and a common end is one link.
    """
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *["groups"] * keep_groups]
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary" + ", groups string" * keep_groups

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        t = tokenizers(a, b, ranks)

        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            begin, held = 0, 0
            for end, text in enumerate(texts, 1):
                held += len(text)
                if held < RUN_CHARS and end < len(texts):
                    continue
                rows = []
                for n_a, n_b, n, groups, pairs, times in aligned(t.encode(texts[begin:end]), t.shown, t.a_sizes, t.b_sizes):
                    sha = hashlib.sha256(groups.encode()).hexdigest() if n_a else ""
                    rows.append((n_a, n_b, n, n, sha, pairs.tobytes(), times.tobytes(), *[groups] * keep_groups))
                types = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), *[pa.string()] * keep_groups]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), *(pa.array(x, k) for x, k in zip(zip(*rows, strict=True), types, strict=True))], names)
                begin, held = end, 0

        return each

    return map_batches(docs.select(F.col(doc).cast("long").alias("doc_id"), "text"), make, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n): how many links of all rows of align() hold each id pair linked. Each task adds its rows up first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[tuple[bytes, bytes]] = []
        size = 0

        def add() -> None:
            nonlocal pairs, n, waiting, size
            more = np.concatenate((pairs, np.frombuffer(b"".join(x for x, _ in waiting), "<u4").astype(np.int64)))
            times = np.concatenate((n, np.frombuffer(b"".join(y for _, y in waiting), "<u4").astype(np.int64)))
            order = np.argsort(more, kind="stable")
            more, times = more[order], times[order]
            first = np.flatnonzero(np.append(True, more[1:] != more[:-1])) if len(more) else np.zeros(0, np.int64)
            pairs, n, waiting, size = more[first], np.add.reduceat(times, first) if len(first) else times, [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                waiting.append((x, y))
                size += len(x) // 4
                if size >= HELD // 4:
                    add()
                    if len(pairs) >= HELD:
                        yield out()
                        pairs, n = pairs[:0], n[:0]
        add()
        yield out()

    return found.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(found: DataFrame, listed: int = LISTED) -> DataFrame:
    """Adds n_best and count_sum to saved rows of align(): links whose pair is counted most among its B id's pairs, ties included, and the sum of the counts of all links.

    Counts of the most frequent pairs, at most `listed`, and the highest count of each B
    id, at most 65,536, go to every task. A pair beyond them is rare, so its rows, few,
    meet its count in a join and are added up by row.
    """
    spark = found.sparkSession
    with Scratch(spark) as scratch:
        counts = scratch.saved(pair_counts(found), "counts")
        # Buckets of counts by powers of the square root of two, 128 at most, tell how far the list can go down.
        level = F.floor(2 * F.log2("n")).cast("int")
        least, taken, beyond = 0, 0, False
        for bucket, pairs in sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).agg(F.count("*")).collect()), reverse=True):
            if beyond or taken + pairs > listed:
                beyond = True
                break
            least, taken = bucket, taken + pairs
        frequent = counts.where(level >= least) if taken else counts.limit(0)
        top = frequent.orderBy("pair").toArrow()
        best = counts.groupBy((F.col("pair") % (1 << 16)).alias("b")).agg(F.max("n").alias("most"))
        most = np.zeros(1 << 16, np.int64)
        for b, n in best.collect():
            most[b] = n
        known = spark.sparkContext.broadcast((top.column(0).to_numpy().astype(np.int64), top.column(1).to_numpy().astype(np.int64), most))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)

        def make(rest: bool) -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
            keys, n, highest = known.value

            def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
                x, y = batch.column("pairs").to_pylist(), batch.column("times").to_pylist()
                pairs, times = (np.frombuffer(b"".join(z), "<u4").astype(np.int64) for z in (x, y))
                ends = np.cumsum([0, *(len(z) // 4 for z in x)])
                at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
                there = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
                if rest:
                    miss = np.flatnonzero(~there)
                    owner = np.searchsorted(ends, miss, "right") - 1
                    yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(owner)), pa.array(pairs[miss]), pa.array(times[miss]), pa.array(highest[pairs[miss] & 0xFFFF])], ["row", "pair", "times", "most"])
                    return
                each_n = np.where(there, n[at], 0) if len(keys) else np.zeros(len(pairs), np.int64)
                add = lambda v: pa.array(np.diff(np.append(0, np.cumsum(v))[ends]))
                yield pa.RecordBatch.from_arrays([*batch.columns, add(np.where(there & (each_n == highest[pairs & 0xFFFF]), times, 0)), add(each_n * times)], [*batch.schema.names, "n_best", "count_sum"])

            return each

        source, row = found.withColumn("row", file_row(found)), "row struct<f:bigint,i:bigint>"
        out = map_batches(source, lambda: make(False), f"{kinds}, {row}, n_best long, count_sum long")
        if beyond:
            rare = map_batches(source, lambda: make(True), f"{row}, pair long, times long, most long").join(counts.where(level < least) if taken else counts, "pair")
            more = rare.groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("__sum"), F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("__best"))
            out = out.join(more, "row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("__best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("__sum", F.lit(0))})
        return saved(out.select(*(c for c in found.columns if c not in ("pairs", "times")), "n_best", "count_sum"), "alignment")


def align_corpus(docs: DataFrame, a: str | None = None, b: str | None = None, ranks: str | None = None, doc: str = "doc_id", keep_groups: bool = False, listed: int = LISTED) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs (doc_id, text), and its groups if asked.

    Null and empty texts, and those whose joined token bytes of A or B are not space+text,
    have zeros and an empty checksum. Rows of equal or null id are aligned each on its own
    and all count for the corpus; an empty table gives no rows; other columns are not
    read. A text of any length is tokenised in runs of a million characters where it has
    a blank between two word characters; its ids, some 20 bytes a token, are in memory.
    """
    if a is None:
        a, ranks = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.saved(align(docs, a, b or vocabulary("piece_bpe_32k.model"), ranks, doc, keep_groups), "aligned")
        out = with_counts(found, listed)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * keep_groups)
