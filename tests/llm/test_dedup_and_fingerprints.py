"""Near-duplicates and fingerprints against sets of word tuples."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickloom.llm import common, fingerprints, near_dedup
from tickloom.llm.common import Scratch, file_row
from tickloom.llm.components import connected_components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def result(docs, row=None):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs, row).collect())


def test_near_duplicates_equal_brute_force(documents):
    assert result(documents, file_row(documents)) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    assert result(odd_docs) == brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert result(no_docs) == []


def test_chains_and_large_groups_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_MEMBERS", 20)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows, text = [], list(base)
    for i in range(60):  # a chain whose ends are far apart
        text = list(text)
        text[(i * 7) % 120] = f"n{i}"
        rows.append((i, " ".join(text)))
    for i in range(60, 220):  # many copies of one text with one or two edits
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(120)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    for i in range(220, 300):  # a shared passage among texts that differ
        rows.append((i, " ".join(base[:40] + [f"u{rng.randrange(10**6)}" for _ in range(60)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(docs) == brute(rows)


def one_bucket(spark, texts, comps, bands):
    """Inputs of the last comparison: classes of texts that share the bucket 7."""
    nodes = []
    for text in texts:
        s, t = near_dedup.set_hashes(*near_dedup.shingle_sets([text.encode()]))
        nodes.append((int(s[0]), int(t[0])))
    rows = [(7, nodes[d], nodes[comps[d]], len(shingles(text)), text, bands(d)) for d, text in enumerate(texts)]
    df = spark.createDataFrame(rows, "key long, node struct<s: long, t: long>, comp struct<s: long, t: long>, n long, text string, bands array<long>")
    return nodes, (df.select("key", "node", "comp", F.lit(len(texts)).cast("long").alias("m")), df.select("node", "n", "bands"), df.select("node", "text"))


def test_a_large_bucket_loses_no_pair_that_shares_only_it(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_MEMBERS", 8)
    rng = random.Random(6)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(100)] for _ in range(30)]
    texts = [" ".join(x) for x in base] + [" ".join([*x[:-1], "changed"]) for x in base]
    nodes, inputs = one_bucket(spark, texts, range(60), lambda d: [7, *(1000 * d + k for k in range(39))])
    with Scratch(spark) as scratch:
        rest = near_dedup._rest(*inputs, len(texts), scratch)
        got = {frozenset((tuple(r.hub), tuple(r.member))) for r in rest.collect()}
        links = near_dedup.verify(near_dedup.star_units(rest), inputs[2]).collect()
    assert got == {frozenset((nodes[d], nodes[d + 30])) for d in range(30)} == {frozenset((tuple(r.a), tuple(r.b))) for r in links}


def test_a_hub_is_spread_over_units_and_no_pair_is_lost(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "UNIT_MEMBERS", 4)
    rows = [((h, h), (100 + i, i), m) for h, m in ((1, 3), (2, 1000), (3, 60)) for i in range(m)]
    pairs = spark.createDataFrame(rows, "hub struct<s: long, t: long>, member struct<s: long, t: long>, m long")
    units = near_dedup.star_units(pairs).collect()
    assert sorted((tuple(r.hub), tuple(r.member)) for r in units) == sorted(r[:2] for r in rows)
    assert max(Counter(r.unit for r in units).values()) <= 20
    assert all(len({r.hub for r in units if r.unit == u}) == 1 for u in {r.unit for r in units})


def test_null_and_repeated_ids(spark):
    t = " ".join(f"w{i}" for i in range(60))
    near = t.replace("w59", "other")
    u = " ".join(f"u{i}" for i in range(60))
    docs = spark.createDataFrame([(1, t), (2, u), (2, t), (None, near), (None, u + " x"), (None, "alone " * 3), (None, "alone " * 3), (7, "\n\t"), (7, t), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 56, 1, True), (2, 56, 2, True), (2, 56, 1, False), (None, 56, 1, False), (None, 57, 2, False), (None, 1, None, True), (None, 1, None, True), (7, 0, 7, True), (7, 56, 1, False), (None, 0, None, True)], key=str)
    one = near_dedup.one_of_each(docs).collect()
    assert sorted(map(str, one)) == sorted(map(str, [Row(doc_id=d, text=x) for d, x in ((1, t), (2, u), (None, "alone " * 3), (7, "\n\t"), (None, None))]))


def test_rows_of_a_file_are_told_apart(spark, documents):
    row = file_row(documents)
    assert documents.select(row).distinct().count() == documents.count()
    assert file_row(spark.createDataFrame([(1,)], "a int")) is None


def test_scratch_tables_are_deleted(spark, odd_docs):
    with Scratch(spark) as scratch:
        held = scratch.saved(odd_docs)
        assert held.count() == odd_docs.count()
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST|does not exist"):
        spark.read.parquet(scratch.paths[0]).count()


def test_spread_join_cuts_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(common, "PIECES", 10)
    rows = spark.createDataFrame([(None if i % 7 == 0 else min(i % 50, 3), i) for i in range(1000)], "k int, i int")
    small = rows.where("k < 3 or k is null").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most"))
    every = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most"))
    for side in (small, every, small.unionByName(small.withColumn("most", F.lit(-1)))):
        want = sorted(map(str, rows.join(side.drop("n"), "k").collect()))
        assert sorted(map(str, common.spread_join(rows, side, "k", "n", 1000).collect())) == want
    known = rows.join(every.select("k", "n"), "k")
    assert sorted(map(str, common.spread_join(known, every, "k", "n", 1000).select("k", "i", "most").collect())) == sorted(map(str, rows.join(every.drop("n"), "k").collect()))
    assert common.spread_join(rows.limit(0), small.limit(0), "k", "n", 0).count() == 0


def test_a_large_group_with_outsiders_ends_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_MEMBERS", 40)
    comp = {(k, d): 0 if d < size else d if d % 2 else size for k, size, n in ((1, 300, 301), (2, 100, 170), (3, 20, 30), (4, 90, 90)) for d in range(n)}
    rows = spark.createDataFrame([(k, (d, d), (c, c)) for (k, d), c in comp.items()], "key long, node struct<d: long, s: long>, comp struct<d: long, s: long>")
    tasks = {}
    dealt = near_dedup._dealt(rows.join(rows.groupBy("key").agg(F.count("*").alias("m")), "key"), rows.count()).collect()
    for r in dealt:
        tasks.setdefault((r.key, r.i, r.j), ([], []))[r.side].append(r.node.d)
    assert max(len(a) + len(b) for a, b in tasks.values()) <= 80
    assert sum(len(a) + len(b) for (k, _, _), (a, b) in tasks.items() if k == 1) <= 300 + 20
    met = []
    for (k, i, j), (a, b) in tasks.items():
        met += [(k, *sorted((x, y))) for x in a for y in b]
        met += [(k, x, y) for x in a for y in a if x < y] if i == j else []
    met = [m for m in met if comp[m[0], m[1]] != comp[m[0], m[2]]]
    assert sorted(met) == sorted((k, x, y) for k, x in comp for q, y in comp if q == k and x < y and comp[k, x] != comp[k, y])


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a in label and b in label:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_edited_pairs(documents):
    rows = sorted(((r.doc_id, r.text) for r in documents.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.edited_pairs(documents).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (d, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = shingles(text.lower()), shingles(other.lower())
            errors.append(near - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < 0.05


@pytest.mark.parametrize("ids", [
    [i * i for i in range(200)], [*range(-(2**63), -(2**63) + 40), 0, *range(2**63 - 40, 2**63)], [*range(60), 2**62], [7] * 50 + [8, 9, 2**60], [None] * 30 + [1, 2**63 - 1, -(2**63)], [5], [2**60 + i for i in range(100)] + [-3],
], ids=["squares", "both ends of 64 bits", "one far away", "one id for most", "nulls", "one row", "large and near"])
def test_cells_join_neighbours_however_ids_are_spread(spark, ids):
    docs = spark.createDataFrame([(d, f"t{k}") for k, d in enumerate(ids)], "doc_id long, text string")
    with_tie = docs.withColumn("h", F.xxhash64("text"))
    got = {r.text: r.next_text for r in fingerprints.with_next(docs, "doc_id", ["text"], ["text"], cell_rows=7).collect()}
    order = [r.text for r in sorted(with_tie.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.h), reverse=True)]
    assert got == {a: b for a, b in zip(order, order[1:] + order[:1], strict=True)}
    cells = fingerprints.with_cell(with_tie, "doc_id", "h", 7).groupBy("__cell").count().collect()
    assert max(r["count"] for r in cells) <= 3 * 7


def test_fingerprints_of_odd_rows(odd_docs, no_docs):
    found = fingerprints.edited_pairs(odd_docs).collect()
    assert len(found) == odd_docs.count()
    by_text = {}
    for r, f in zip(sorted(odd_docs.collect(), key=lambda r: -r.doc_id), sorted(found, key=lambda r: -r.doc_id), strict=True):
        if r.doc_id != 6:
            by_text.setdefault((r.text or "").strip(), set()).add(f.fingerprint)
    assert by_text[""] == {""}
    assert all(len(v) == 1 for v in by_text.values())
    assert fingerprints.edited_pairs(no_docs).count() == 0
