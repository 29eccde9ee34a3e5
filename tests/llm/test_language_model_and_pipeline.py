"""The language model against plain counts and numerical gradients; the pipeline against its stages' rules."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tickloom.llm import gated, language_model

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    import re

    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def test_scores(spark, documents, monkeypatch):
    monkeypatch.setattr(language_model, "LISTED", 3000)
    rows = documents.collect()
    out = lambda d: zlib.crc32(str(d).encode()) % 10 == 0
    c = Counter(w for r in rows if not out(r.doc_id) for w in tokens(r.text))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in language_model.score(documents).collect()}
    gain = 0.0
    for r in rows:
        g, t = got[r.doc_id], tokens(r.text)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (out(r.doc_id), len(t), sum(c[w] > 0 for w in t), n)
        assert abs(g.base_score - base) < 1e-6 * abs(base)
        gain += (g.score - g.base_score) * g.held_out
    assert gain > 0


def test_odd_rows(odd_docs, no_docs):
    got = language_model.score(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    assert language_model.score(no_docs).count() == 0


def small_network(seed=1):
    rng = np.random.default_rng(seed)
    p = gated.initial(np.ones(gated.HEAD), np.ones(gated.TAIL_CLASSES), seed)
    return gated.Network({k: (v + rng.standard_normal(v.shape) * 0.2).astype(np.float32) for k, v in p.items()}, 0), rng


def test_probabilities_add_up_and_state_is_carried():
    net, rng = small_network()
    doc = rng.integers(0, gated.INPUTS, 3 * gated.STEPS + 5).astype(np.int32)
    alone = net.stream([doc])[0]
    beside = net.stream([rng.integers(0, gated.INPUTS, 40).astype(np.int32), doc, doc[:7]])[1]
    assert abs(alone - beside) < 1e-2
    heads = [np.array([k], np.int32) for k in range(gated.INPUTS)]
    assert abs(np.exp(net.stream(heads)).sum() - 1) < 1e-3


def test_gradients():
    net, rng = small_network()
    x = rng.integers(0, gated.INPUTS, (6, 4)).astype(np.int32)
    target = rng.integers(0, gated.INPUTS, 24).astype(np.int32)
    keep, live = np.ones((6, 4), np.float32), np.ones(24, np.float32)
    keep[2, 1], live[[3, 20]] = 0, 0
    h0 = rng.random((gated.HIDDEN, 4)).astype(np.float32) - 0.5
    g, found = np.zeros_like(net.theta), np.zeros_like(net.theta)
    net.gradients(x, keep, h0, target, live, found)
    at = 0
    for name, shape in gated.SHAPES.items():
        n = int(np.prod(shape))
        i, eps = at + np.abs(found[at : at + n]).argmax(), 0.02
        sides = []
        for step in (eps, -2 * eps):
            net.theta[i] += step
            sides.append(-net.gradients(x, keep, h0, target, live, g)[0].sum())
        net.theta[i] += eps
        assert abs((sides[0] - sides[1]) / (2 * eps) - found[i]) < 0.02 * abs(found[i]) + 1e-3, name
        at += n
    net.theta *= 40  # beyond what is exponentiated unshifted
    assert np.isfinite(net.gradients(x, keep, h0, target, None, g)[0]).all() and np.isfinite(g).all()


def test_stages(spark, sf):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (_, quality), (_, dedup), (_, mix), (_, pack) = cp.STAGES
    good = quality(spark, docs, sf)
    assert good.columns == docs.columns
    assert 0.5 * docs.count() < good.count() < docs.count()
    one = dedup(spark, good, sf)
    assert one.columns == docs.columns
    assert one.select("text").distinct().count() == one.count() <= good.count()
    mixed = mix(spark, one, sf)
    assert mixed.columns == docs.columns
    assert max(Counter(r.doc_id for r in mixed.select("doc_id").collect()).values()) <= 3
    packed = pack(spark, mixed, sf)
    starts = packed.where("start = 0").count()
    assert starts == mixed.count()


def test_near_dedup_stage_decides_by_row(spark, sf):
    import corpus_pipeline as cp

    t, u = " ".join(f"w{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    docs = spark.createDataFrame([(1, t, "x"), (2, u, "y"), (2, t, "z"), (2, t, "z"), (None, u + " v", "n"), (None, "", "n")], "doc_id long, text string, row string")
    got = cp.near_dedup_stage(spark, docs, sf)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text, r.row) for r in got.collect()) == [(0, "", "n"), (1, t, "x"), (2, u, "y")]


def test_pipeline_odd_rows(spark, odd_docs, no_docs, sf, tmp_path):
    import corpus_pipeline as cp

    long = odd_docs.where("doc_id in (0, 1, 2)").withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("end"), "doc_id")))
    docs = odd_docs.unionByName(long).unionByName(long.where("doc_id = 2"))
    named = docs.withColumnsRenamed({"row": "Counts", "size": "kept", "hub": "f", "key": "__row"})
    named.write.parquet(str(tmp_path / "docs"))
    rows, ids = spark.read.parquet(str(tmp_path / "docs")), []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, rows, sf)
        assert k == 3 or out.columns == rows.columns
        out.write.parquet(str(tmp_path / f"out{k}"))
        rows = spark.read.parquet(str(tmp_path / f"out{k}"))
        ids.append(sorted(r.doc_id for r in rows.collect()))
    # Texts of under 50 words and repeated words fail; all others but the long one are near copies of document 0.
    assert ids[0] == [0, 0, 1, 1, 2, 2, 2, 9] and ids[1] == [0, 9]
    assert set(ids[2]) <= {0, 9} and set(ids[3]) == set(ids[2])
    assert rows.where("start = 0").count() == len(ids[2])
    start = no_docs
    for _, stage in cp.STAGES:
        start = stage(spark, start, sf)
    assert start.count() == 0


def scalar_log10(symbols, p):
    """log10 probability of a document's symbols by a forward pass of plain numbers, one token after another."""
    n, h, was, total = gated.HIDDEN, [0.0] * gated.HIDDEN, 0, 0.0
    w = {k: v.astype(float).tolist() for k, v in p.items()}

    def log_softmax(rows, weights, at):
        scores = [weights[-1][j] + sum(rows[i] * weights[i][j] for i in range(n)) for j in range(len(weights[0]))]
        most = max(scores)
        return scores[at] - most - math.log(sum(math.exp(s - most) for s in scores))

    for symbol in symbols:
        own = [sum(w["U"][i][j] * h[j] for j in range(n)) for i in range(3 * n)]
        into = [w["Wx"][i][was] + w["b"][i] for i in range(3 * n)]
        gate = [1 / (1 + math.exp(into[i] + own[i])) for i in range(2 * n)]
        new = [math.tanh(into[2 * n + i] + gate[n + i] * own[2 * n + i]) for i in range(n)]
        h = [gate[i] * h[i] + (1 - gate[i]) * new[i] for i in range(n)]
        head = symbol < gated.HEAD
        cls = symbol // gated.CLASS_WORDS if head else symbol - gated.HEAD + gated.HEAD_CLASSES
        total += log_softmax(h, w["Wc"], cls)
        if head:
            total += log_softmax(h, w["Wo"][cls], symbol % gated.CLASS_WORDS)
        was = symbol
    return total / math.log(10)


def test_scores_equal_a_scalar_forward_pass_of_the_trained_network(spark, documents, monkeypatch):
    monkeypatch.setattr(language_model, "LISTED", 3000)
    trained, real = [], language_model.network_scores
    monkeypatch.setattr(language_model, "network_scores", lambda rows, params: trained.append(params.value) or real(rows, params))
    got = {r.doc_id: r.score for r in language_model.score(documents).collect()}
    rows = documents.collect()
    counts = Counter(w for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10 for w in tokens(r.text))
    ranked = sorted((w for w in counts if w is not None), key=lambda w: (-counts[w], w))
    # Only words of the listing may be head words; those of the least listed count are all in or all out.
    head = {w: i for i, w in enumerate(ranked[: gated.HEAD - 1], 1)}
    cls = lambda w: int(language_model.shape_classes([w.encode()])[0])
    masses = [0.1] * gated.TAIL_CLASSES
    for w in ranked[gated.HEAD - 1 :]:
        masses[cls(w)] += counts[w] + 0.1
    p = gated.unflat(trained[0])
    for r in sorted(rows, key=lambda r: len(r.text or ""))[20:160:28]:
        symbols, inside = [], 0.0
        for w in tokens(r.text):
            if w is None or w in head:
                symbols.append(0 if w is None else head[w])
            else:
                symbols.append(gated.HEAD + cls(w))
                inside += math.log10((counts[w] + 0.1) / masses[cls(w)])
        assert abs(scalar_log10(symbols, p) + inside - got[r.doc_id]) < 2e-4 * abs(got[r.doc_id]), r.doc_id


def test_words_of_pieces_and_slices_of_a_column(monkeypatch):
    import pyarrow as pa

    texts = ["  Ab\tcÉ  x\n", None, "", " ", "one", *(f"A{chr(i)}B {i % 7} ÉcolE{i}" for i in range(1, 300)), "y " * 500]
    plain = [[w.encode() for w in tokens(t)[:-1]] for t in texts]
    vocabulary = language_model.Vocabulary(language_model.Listing(pa.array(["one", "y", "3"]), np.array([3, 2, 1]), 1, 9, 4, np.ones(gated.TAIL_CLASSES)))
    for size, skip in ((1 << 20, 0), (200, 0), (200, 60)):
        monkeypatch.setattr(language_model, "CHUNK", size)
        seen = skip
        for begin, words, n in language_model.split_words(pa.array(texts).slice(skip)):
            assert begin == seen - skip
            _, numbers, _, rare = vocabulary.read(words, n)
            own = plain[seen : seen + len(n)]
            assert words.cast(pa.binary()).to_pylist() == [w for t in own for w in t] and n.tolist() == [len(t) for t in own]
            assert numbers.tolist() == [k for t in own for k in [*({b"one": 1, b"y": 2, b"3": 3}.get(w, -1) for w in t), 0]]
            assert [{x["word"].encode(): x["times"] for x in r} for r in rare.to_pylist()] == [Counter(w for w in t if w not in (b"one", b"y", b"3")) for t in own]
            seen += len(n)
        assert seen == len(texts)


def test_a_long_text_leaves_many_lanes():
    docs = [(k, np.zeros(20_000 if k == 0 else 1000, np.int32)) for k in range(3300)]
    (stream,) = language_model._streams(iter(docs))
    assert gated.Lanes([d for _, d in stream], gated.LANES).target.shape[1] >= 160
