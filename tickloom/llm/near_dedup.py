"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A shingle's index in a universe of 2^32 comes from one permutation; a second one gives
its value, and the k-th signature coordinate is the least value after shifting the
indices by k places round the universe, so two permutations serve every coordinate.
Rows of equal sets are one class; classes that agree in a band share a bucket. In each
bucket every class is first compared with one hub, then with the class that turned out
to have most links; classes of a bucket that are still in different components are
compared with each other by their signatures, and the close ones on their texts. Every link is confirmed on the full shingle sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import ROW, Scratch, as_bytes, chunked, map_batches, parts, saved, spread_join, with_row
from tickloom.llm.components import connected_components
from tickloom.llm.words import mix, shingle_sets

#: A pair at the least likeness 0.75 shares no band with probability (1 - 0.75^5)^40 = 2e-5.
BANDS, ROWS = 40, 5
#: Members that one verification unit compares with a hub, on average.
UNIT_MEMBERS = 64
#: Units over which the pairs of one class spread that the last comparison finds, at most.
REST_UNITS = 64
#: Members that one task compares, on average; a larger bucket is cut into blocks, and each two of them meet in a task.
BUCKET_MEMBERS = 4096
#: Coordinates of the signatures compared there, and the share of equal low bytes from which a pair is verified. At likeness
#: 0.75 the share is 0.75 +- 0.0137, so a pair falls short with probability 6e-6.
LONG, LEAST_SHARE = 1000, 0.69
_SHIFT = np.uint32(0x9E3779B1)
_BAND_KEYS = mix(np.arange(1, BANDS + 1, dtype=np.uint64))


def _permute32(x: np.ndarray, spare: np.ndarray) -> None:
    """The second permutation, a bijection of 32-bit integers, in place."""
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, None)):
        np.right_shift(x, np.uint32(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint32(factor), out=x)


def signatures(hashes: np.ndarray, starts: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Signature of each set; sets are runs of `hashes` that begin at `starts`, none of them empty."""
    index = (mix(hashes ^ np.uint64(0xA5A5A5A5DEADBEEF)) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(starts), size), np.uint32)
    value, spare = np.empty_like(index), np.empty_like(index)
    for k in range(size):
        np.add(index, np.uint32((k * int(_SHIFT)) & 0xFFFFFFFF), out=value)
        _permute32(value, spare)
        out[:, k] = np.minimum.reduceat(value, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts_ = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    keys = np.tile(_BAND_KEYS, (len(signature), 1))
    for j in range(ROWS):
        keys = mix(keys ^ parts_[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def with_bands(docs: DataFrame) -> DataFrame:
    """ROW, doc_id, n_shingles, a 128-bit hash of the set (s, t) and the band keys of every row's whole text."""

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            texts = as_bytes(batch.column(2))
            for begin, some in chunked(texts, 1 << 18):
                hashes, counts = shingle_sets(some)
                n = len(some)
                bands, (s, t) = [[]] * n, set_hashes(hashes, counts)
                full = np.flatnonzero(counts)
                if len(full):
                    for i, keys in zip(full.tolist(), band_keys(signatures(hashes, (np.cumsum(counts) - counts)[full])), strict=True):
                        bands[i] = keys
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(begin, n) for i in range(2)), pa.array(counts, pa.int64()), pa.array(s), pa.array(t), pa.array(bands, pa.list_(pa.int64()))], ["row", "doc_id", "n_shingles", "s", "t", "bands"])

        return each

    schema = "row struct<f: long, i: long>, doc_id long, n_shingles long, s long, t long, bands array<long>"
    return map_batches(docs.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long"), "text"), make, schema)


def set_hashes(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, 0 for an empty one."""
    s, t, full = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.uint64), np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        s[full] = np.add.reduceat(mix(hashes), starts)
        t[full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return s.view(np.int64), t.view(np.int64)


def _alike(a: Column, b: Column) -> Column:
    """Set sizes that allow a Jaccard likeness of 0.75."""
    return 100 * F.least(a, b) >= 75 * F.greatest(a, b)


def star_units(pairs: DataFrame) -> DataFrame:
    """Verification units (unit, hub, member) of distinct pairs (hub, member, m), m being the size of the largest bucket that they share.

    Members go to as many units as their bucket takes, told from the pair alone, so a hub
    with any number of members is never gathered: pairs of buckets of up to 2^k times
    UNIT_MEMBERS spread over 2^k units, and a hub has at most BANDS such buckets.
    """
    level = F.greatest(F.ceil(F.log2(F.col("m") / UNIT_MEMBERS)), F.lit(0))
    return pairs.select(F.xxhash64("hub", level, F.pmod(F.xxhash64("member"), F.pow(F.lit(2), level).cast("long"))).alias("unit"), "hub", "member")


def verify(units: DataFrame, texts: DataFrame) -> DataFrame:
    """The links among units (unit, hub, member), one hub in each: pairs (a, b) whose full sets have 100 * intersection >= 75 * union.

    A class is the two hashes of its set; texts has (node, text). In a unit's task the
    hub comes first and each member is compared as it comes, so a task holds two sets.
    """
    hubs = units.select("unit", F.col("hub").alias("node"), F.lit(0).alias("role")).distinct()
    rows = hubs.unionByName(units.select("unit", F.col("member").alias("node"), F.lit(1).alias("role"))).join(texts, "node")
    rows = rows.select("unit", "role", F.col("node.s").alias("s"), F.col("node.t").alias("t"), "text")
    rows = rows.repartition(parts(units.sparkSession), "unit").sortWithinPartitions("unit", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub, who = None, np.zeros(0, np.uint64), (0, 0)
        for batch in batches:
            unit, role, s, t = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for begin, some in chunked(as_bytes(batch.column(4))):
                hashes, counts = shingle_sets(some)
                ends = np.cumsum(counts).tolist()
                for i, end in enumerate(ends, begin):
                    mine = hashes[end - counts[i - begin] : end]
                    if role[i] == 0:
                        at, hub, who = unit[i], mine, (s[i], t[i])
                    elif unit[i] == at:
                        both = int((hub[np.minimum(np.searchsorted(hub, mine), len(hub) - 1)] == mine).sum())
                        if 100 * both >= 75 * (len(hub) + len(mine) - both):
                            out.append((*who, s[i], t[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "s", "t"])

    found = rows.mapInArrow(run, "a long, b long, s long, t long")
    return found.select(F.struct(F.col("a").alias("s"), F.col("b").alias("t")).alias("a"), F.struct("s", "t").alias("b"))


def _labels(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of linked classes: the most linked class within four steps, each to the most linked neighbour.

    Members of a star have their hub, so this is all that deciding what to compare next
    needs; two labels in one component cost comparisons, never a link.
    """
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    degrees = both.groupBy("other").agg(F.count("*").alias("n"), F.count("*").alias("degree"))
    ranked = spread_join(both, degrees, "other", "n", 2 * links.count()).groupBy("node").agg(F.max(F.struct("degree", "other")).alias("top"), F.count("*").alias("own"))
    up = scratch.saved(ranked.select("node", F.greatest(F.col("top"), F.struct(F.col("own").alias("degree"), F.col("node").alias("other")))["other"].alias("component")), "labels")
    total = up.count()
    for _ in range(2):  # each label is a node with a label of its own; two steps, then four
        above = up.select(F.col("node").alias("component"), F.col("component").alias("above"))
        met = up.groupBy("component").agg(F.count("*").alias("n")).join(above, "component")
        up = scratch.saved(spread_join(up, met, "component", "n", total).select("node", F.col("above").alias("component")), "labels")
    return up


def _mixed(rows: DataFrame, comps: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """Bucket rows (key, node, n, m) with their component, of buckets that hold more than one."""
    held = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    per = held.groupBy("key").agg(F.min("comp").alias("least"), F.max("comp").alias("most"), F.first("m").alias("m")).where("least <> most").select("key", "m")
    return scratch.saved(spread_join(held, per, "key", "m", total), "mixed")


def _further_star(mixed: DataFrame, links: DataFrame, total: int) -> DataFrame:
    """Pairs (hub, member, m) of each bucket's most linked class with the bucket's classes in other components."""
    ends = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node")))
    known = mixed.join(ends.groupBy("node").agg(F.count("*").alias("degree")), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    hub = known.groupBy("key").agg(F.max_by(F.struct("node", "n", "comp"), F.struct("degree", "node")).alias("hub"), F.first("m").alias("m"))
    pairs = spread_join(mixed, hub, "key", "m", total).where((F.col("comp") != F.col("hub.comp")) & _alike(F.col("hub.n"), F.col("n")))
    return pairs.groupBy(F.col("hub.node").alias("hub"), F.col("node").alias("member")).agg(F.max("m").alias("m"))


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    both = tried.select("hub", "member").unionByName(tried.select(F.col("member").alias("hub"), F.col("hub").alias("member")))
    return pairs.join(both, ["hub", "member"], "left_anti")


def _long_signatures(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, low): the low bytes of LONG coordinates of each class among nodes (node)."""

    def make() -> Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]]:
        def each(batch: pa.RecordBatch) -> Iterable[pa.RecordBatch]:
            for begin, some in chunked(as_bytes(batch.column(1)), 1 << 18):
                hashes, counts = shingle_sets(some)
                low = signatures(hashes, np.cumsum(counts) - counts, LONG).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(some)), pa.array([x.tobytes() for x in low], pa.binary())], ["node", "low"])

        return each

    return map_batches(texts.join(nodes.distinct(), "node").select("node", "text"), make, "node struct<s: long, t: long>, low binary")


def _close(key: int, bucket: list[tuple], comps: np.ndarray, left: int, inside: bool) -> Iterator[tuple]:
    """(a, b, s, t) of rows (s, t, n, low, bands) in different components whose sizes and signatures are close.

    The first `left` rows are compared with the others, and with each other too if
    `inside`. Rows that share an earlier band meet there and not here.
    """
    n = np.array([x[2] for x in bucket], np.int64)
    low = np.frombuffer(b"".join(x[3] for x in bucket), np.uint8).reshape(len(bucket), -1)
    bands = np.array([x[4] for x in bucket], np.int64)
    here = np.flatnonzero(bands[0] == key)
    for i in range(left):
        at = i + 1 if inside else left
        j = at + np.flatnonzero((comps[at:] != comps[i]) & (100 * np.minimum(n[at:], n[i]) >= 75 * np.maximum(n[at:], n[i])))
        if len(j) and len(here):
            j = j[~(bands[j, : here[0]] == bands[i, : here[0]]).any(1)]
        if len(j):
            j = j[(low[j] == low[i]).mean(1) >= LEAST_SHARE]
        for k in j.tolist():
            yield *bucket[i][:2], *bucket[k][:2]


def _dealt(rows: DataFrame, total: int) -> DataFrame:
    """Bucket rows (key, node, comp, m) dealt to comparing tasks (key, i, j), with their side there.

    Rows of a bucket's largest component are linked already; only the others, the
    outsiders, are compared, with each other and with those. A bucket of more than
    BUCKET_MEMBERS is cut by hash into blocks of about half as many, outsiders and largest
    component apart. An outsiders' block i meets itself and each other block j in one task,
    i on side 0 and j on side 1, so every pair of an outsider meets once.
    """
    half, comps = BUCKET_MEMBERS / 2, rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.first("m").alias("m"))
    per = comps.groupBy("key").agg(F.sum("c").alias("held"), F.max(F.struct("c", "comp")).alias("most"), F.first("m").alias("m")).where("held > most.c")
    blocks = F.ceil((F.col("held") - F.col("most.c")) / half).cast("int").alias("outer"), F.ceil(F.col("most.c") / half).cast("int").alias("inner")
    per = per.select("key", (F.col("held") <= BUCKET_MEMBERS).alias("whole"), F.col("most.comp").alias("main"), *blocks, "m")
    cut = spread_join(rows, per, "key", "m", total).withColumn("linked", F.col("comp") == F.col("main"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("linked"), F.col("inner")).otherwise(F.col("outer"))).cast("int"))

    def task(i: Column, j: Column, side: Column) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), side.cast("int").alias("side"))

    block, outer = F.col("block"), F.sequence(F.lit(0), F.col("outer") - 1)
    own = F.concat(F.transform(outer, lambda x: task(F.least(block, x), F.greatest(block, x), x < block)), F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda x: task(block, F.col("outer") + x, F.lit(0))))
    met = F.when(F.col("whole"), F.array(task(F.lit(0), F.lit(0), F.col("linked")))).when(F.col("linked"), F.transform(outer, lambda x: task(x, F.col("outer") + block, F.lit(1)))).otherwise(own)
    return cut.select("key", "node", "comp", F.explode(met).alias("t")).select("key", "t.i", "t.j", "t.side", "node", "comp")


def _rest(rows: DataFrame, classes: DataFrame, texts: DataFrame, total: int, scratch: Scratch) -> DataFrame:
    """Pairs (hub, member, m) of bucket rows (key, node, comp, m) in different components that look alike.

    classes has (node, n, bands). The rows of a comparing task stream through it; it
    compares their signatures and hands on what is close.
    """
    n = parts(rows.sparkSession)
    classes = scratch.saved(classes.join(_long_signatures(texts, rows.select("node")), "node"), "signed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, held, comps, left = None, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            codes = {c: i for i, c in enumerate(dict.fromkeys(comps))}
            found = _close(task[0], held, np.array([codes[c] for c in comps]), left, task[1] == task[2]) if len(codes) > 1 else iter(())
            while some := list(islice(found, 10_000)):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*some, strict=True)], ["a", "b", "s", "t"])

        for batch in batches:
            for k, i, j, side, s, t, cs, ct, m, low, bands in zip(*(batch.column(i).to_pylist() for i in range(11)), strict=True):
                if (k, i, j) != task:
                    yield from close()
                    task, held, comps, left = (k, i, j), [], [], 0
                held.append((s, t, m, low, bands))
                comps.append((cs, ct))
                left += side == 0
        yield from close()

    full = _dealt(rows, total).join(classes, "node").select("key", "i", "j", "side", F.col("node.s").alias("s"), F.col("node.t").alias("t"), F.col("comp.s").alias("cs"), F.col("comp.t").alias("ct"), "n", "low", "bands")
    made = full.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side").mapInArrow(run, "a long, b long, s long, t long")
    pairs = made.distinct().select(F.struct(F.col("a").alias("s"), F.col("b").alias("t")).alias("hub"), F.struct("s", "t").alias("member"), F.lit(REST_UNITS * UNIT_MEMBERS).alias("m"))
    return scratch.saved(pairs, "pairs")


def judged(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """ROW, doc_id, n_shingles, component_id, kept and first of every row of docs (doc_id, text), as a table.

    first marks one row of each component: the one of the smallest doc_id, the first of
    those if it repeats. Other columns are as near_duplicates says.
    """
    docs = (with_row(docs.select("doc_id", "text"), None) if row is None else with_row(docs, row)).select(ROW, "doc_id", "text")
    with Scratch(docs.sparkSession) as scratch:
        sets = scratch.saved(with_bands(docs), "sets")
        best = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row")
        node = F.struct("s", "t").alias("node")
        classes = scratch.saved(sets.where("n_shingles > 0").groupBy("s", "t").agg(F.min(best).alias("best"), F.count("*").alias("held"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")).select(node, "best", "held", "n", "bands"), "classes")
        # A bucket's hub is its class of the smallest doc_id: what others were copied from is mostly the oldest.
        rows = classes.select("node", "n", F.col("best.doc_id").alias("d"), F.explode("bands").alias("key"))
        total = classes.count() * BANDS
        hubs = rows.groupBy("key").agg(F.count("*").alias("m"), F.count("*").alias("bucket"), F.min(F.struct(F.col("d").isNull(), "d", "node", "n")).alias("hub")).where("m > 1")
        multi = scratch.saved(spread_join(rows.drop("d"), hubs, "key", "m", total).withColumnRenamed("bucket", "m"), "buckets")
        star = multi.where((F.col("hub.node") != F.col("node")) & _alike(F.col("hub.n"), F.col("n"))).groupBy(F.col("hub.node").alias("hub"), F.col("node").alias("member")).agg(F.max("m").alias("m"))
        star = scratch.saved(star, "star")
        wanted = multi.select("node").distinct().join(classes, "node").select("node", F.col("best.row").alias(ROW))
        texts = scratch.saved(docs.select(ROW, "text").hint("merge").join(wanted, ROW).select("node", "text"), "texts")
        links = scratch.saved(verify(star_units(star), texts), "links")
        rows = multi.select("key", "node", "n", "m")
        second = scratch.saved(_untried(_further_star(_mixed(rows, _labels(links, scratch), total, scratch), links, total), star), "star")
        links = links.unionByName(scratch.saved(verify(star_units(second), texts), "links"))
        rest = _rest(_mixed(rows, _labels(links, scratch), total, scratch).select("key", "node", "comp", "m"), classes.select("node", "n", "bands"), texts, total, scratch)
        links = links.unionByName(scratch.saved(verify(star_units(rest), texts), "links"))
        comps = connected_components(links, scratch)
        linked = classes.select("node", "best").join(comps, "node")
        least = linked.groupBy("component").agg(F.min("best").alias("least"), F.count("*").alias("n"))
        of = spread_join(linked.select("node", "component"), least, "component", "n", comps.count()).select("node", "least")
        of = classes.select("node", "best", "held").join(of, "node", "left").select("node", "held", F.coalesce("least", "best").alias("least"))
        known = sets.select("row", "doc_id", "n_shingles", node)
        met = spread_join(known.where("n_shingles > 0"), of, "node", "held", sets.count()).drop("node")
        out = met.unionByName(known.where("n_shingles = 0").drop("node").withColumn("least", best))
        component = F.col("least.doc_id").alias("component_id")
        return saved(out.select(F.col("row").alias(ROW), "doc_id", "n_shingles", component, F.col("doc_id").eqNullSafe(F.col("least.doc_id")).alias("kept"), (F.col("row") == F.col("least.row")).alias("first")), "judged")


def near_duplicates(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Lower-case A-Z; a set is the distinct shingles of five words, or the whole sequence
    of fewer; a null, empty or blank text has none and is linked with nothing. Links join
    sets with 100 * intersection >= 75 * union; component_id is the smallest doc_id
    reachable, and kept says that it is the row's own. Rows of equal doc_id are judged
    each by its own text. A row of null doc_id is linked like any other; component_id is
    null only where all rows of a component have none. An empty table gives no rows.
    A text of any length is hashed in pieces of a megabyte; its shingles, eight bytes
    each, are in memory. Sets are equal where two 64-bit hashes of theirs are, and links
    compare sets of 64-bit shingle hashes: any two of 10^10 different sets share both
    hashes with odds under 1e-18, and a pair of 1,000 shingles each holds two different
    ones of equal hash with odds under 1e-13. `row` tells rows apart (see file_row); without it docs is written first.
    """
    return judged(docs, row).drop(ROW, "first")


def one_of_each(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """The rows of docs (doc_id, text and any other columns) without near copies: one row of each component stays.

    That is the row of the smallest doc_id, null ids last; of equal ids one. Rows without
    words are linked with nothing, so all of them stay. An empty table gives no rows.
    """
    own = with_row(docs, row)
    keep = judged(own, F.col(ROW)).where("first").select(ROW)
    return own.hint("merge").join(keep, ROW, "left_semi").select(docs.columns)
