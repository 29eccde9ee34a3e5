"""Quality rules, URL verdicts, shards and mixes against plain loops."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import mixing, quality_rules, sharding, url_filter
from tickloom.llm.queries import URL_RULES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    triples = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + j for i in range(len(w) - 2) if triples[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_counts(request, which):
    docs = request.getfixturevalue(which)
    got = sorted((r.doc_id, *r.counts) for r in quality_rules.with_counts(docs, ["doc_id"]).collect())
    assert got == sorted((r.doc_id, *plain_counts(r.text)) for r in docs.collect())


def test_list_learns_planted_rules():
    rng = np.random.default_rng(2)
    values = {m: rng.random(4000) for m in ("a", "b", "c")}
    bad = (values["a"] > 0.8) | ((values["b"] < 0.3) & (values["c"] > 0.6))
    rules = quality_rules.learn_rules(values, ~bad, np.arange(4000))
    rejected = np.zeros(4000, bool)
    for r in rules:
        rejected |= r.holds(values)
    assert (rejected == bad).mean() > 0.97
    assert quality_rules.learn_rules(values, np.ones(4000, bool), np.arange(4000)) == []


def test_verdicts_on_documents_keep_clean_text(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judged(docs, labels, ["doc_id"]).select("doc_id", "judged.*").join(labels.where("doc_id % 2 = 0"), "doc_id").toPandas()
    sound = got[~got.base_failed]
    assert sound[sound.quality == 1].kept.mean() > 0.97
    assert sound[sound.quality == 0].kept.mean() < 0.5


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 0), (3, 0, None), (9, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality_rules.judged(odd_docs, labels, odd_docs.columns).collect()
    assert len(rows) == odd_docs.count()
    assert not any(r.judged.kept for r in rows if r.text is None or not r.text.strip())
    named = odd_docs.select("doc_id", "text", F.lit("x").alias("n_words"), F.lit(1).alias("kept"), F.lit(2).alias("c0"), F.struct(F.lit(3).alias("base failed")).alias("base_failed"))
    assert sorted(map(str, quality_rules.judged(named, labels, named.columns, into="out").select("out.*").collect())) == sorted(str(r.judged) for r in rows)
    assert quality_rules.judged(named, labels, named.columns, into="out").columns == [*named.columns, "out"]
    assert quality_rules.judged(no_docs, labels, ["doc_id"]).count() == 0
    assert quality_rules.judged(odd_docs, labels.limit(0), ["doc_id"]).count() == len(rows)


def test_the_conditional_expression_equals_the_rules(spark, documents):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = quality_rules.learn_rules(*quality_rules.labelled_rows(docs, labels))
    assert rules
    measured = quality_rules.with_counts(docs, ["doc_id"]).select("doc_id", "counts.*")
    got = measured.select("n_words", "n_repeat_words", *(F.expr(x).alias(f"m_{m}") for m, x in quality_rules.MEASURES.items()), quality_rules.verdict(rules).alias("kept")).toPandas()
    rejected = np.zeros(len(got), bool)
    for rule in rules:
        rejected |= rule.holds({m: got[f"m_{m}"].to_numpy() for m in quality_rules.MEASURES})
    assert rejected.any() and (rejected == ~got.kept).all()
    judged = quality_rules.judged(docs, labels, ["doc_id"]).select("doc_id", "judged.*").toPandas()
    failed = (got.n_words < 50) | (100 * got.n_repeat_words > 50 * got.n_words)
    assert judged.kept.sum() == (got.kept & ~failed).sum() and judged.base_failed.sum() == failed.sum()


def test_one_id_on_many_labelled_rows_counts_once(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (6, 1), (None, 1), (9, None)], "doc_id long, quality int")
    many = odd_docs.unionByName(odd_docs.where("doc_id = 0")).unionByName(odd_docs.where("doc_id = 6"))
    values, good, keys = quality_rules.labelled_rows(many, labels)
    assert sorted(zip(values["n_words"], good, strict=True)) == [(2, True), (60, False)]
    assert len(keys) == 2


def plain_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = [(len(h + p), a == "allow", h + p, a) for h, p, a in URL_RULES if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def test_page_verdicts(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    got = {r.page_id: r for r in url_filter.judge_pages(pages, rules).collect()}
    for r in pages.collect():
        host, path = plain_url(r.url)
        rule, action = plain_rule(host, path)
        g = got[r.page_id]
        assert (g.host, g.path, g.rule) == (host, path, rule)
        assert g.verdict == (action or "allow")


def test_targets_are_resolved_and_meet_their_canonical_form(spark):
    link, fresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rules = spark.createDataFrame([("bad.net", "/", "block")], "host string, path string, action string")
    bad, pages = "https://bad.net/", [(0, "https://far.net/z", None)]
    for k, (page, html, target) in enumerate([
        ("https://v0.net/x", link.format("http://www.t0.net/p/"), "https://t0.net/p"), ("https://v1.net/x", fresh.format("http://m.t1.net/p.html"), "https://t1.net/p"),
        ("https://v2.net/a/b?q", link.format("/p"), "https://v2.net/p"), ("https://v3.net/a/b", fresh.format("c"), "https://v3.net/a/c"), ("https://v4.net/a/b/c", link.format("../d?x=1"), "https://v4.net/a/d?x=1"),
        ("https://v5.net/a", link.format("//t5.net/p"), "https://t5.net/p"), ("https://v6.net", link.format("p"), "https://v6.net/p"), ("https://v7.net/a?b=1", link.format("?c=2"), "https://v7.net/a?c=2"),
    ]):
        pages += [(10 * k + 1, page, html), (10 * k + 2, target, link.format(f"{bad}{k}"))]
    pages += [(91, "https://v9.net/a", link.format("mailto:x@bad.net")), (92, "https://v9.net/b", "<p>")]
    more = spark.createDataFrame([("https://far.net/z", "http://www.t0.net/p.html")], "a string, b string")
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in url_filter.judge_pages(docs, rules, more).collect()}
    assert got == {k: "allow" if k > 90 else "block" for k, _, _ in pages}


def test_blocks_reach_aliases_but_not_explicit_allows(spark):
    link = '<link rel="canonical" href="https://b.example.org/es/x">'
    html = '<html><head><LINK href="https://b.example.org/es/x" rel="canonical"></head>'
    refresh = '<meta http-equiv="refresh" content="0; url=https://www.a.net/p.html#z">'
    pages = [
        (1, "https://a.net/p?utm_source=x", html), (2, "http://m.a.net/p/", None), (3, "https://c.org/q", refresh), (4, "https://other.net/", ""), (5, None, None), (6, "no url", "x"),
        (7, "HTTP://B.Example.ORG/es/x?y#z", ""), (8, "https://other.net/", None), (9, "https://x.com/de/1", None), (10, "http://evilexample.org", None), (11, "https://far.net/z", None),
    ]
    docs = spark.createDataFrame([(*p, "h", "p") for p in pages], "page_id long, url string, html string, host string, verdict string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    more = spark.createDataFrame([("https://far.net/z", "https://x.com/de/1"), (None, "x")], "a string, b string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_pages(docs, rules, more).collect()}
    assert got == {
        1: ("a.net", "/p", None, "block"), 2: ("m.a.net", "/p/", None, "block"), 3: ("c.org", "/q", "org/", "allow"), 4: ("other.net", "/", None, "allow"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("b.example.org", "/es/x", "example.org/es/", "block"), 8: ("other.net", "/", None, "allow"), 9: ("x.com", "/de/1", "com/de/", "block"), 10: ("evilexample.org", "", None, "allow"), 11: ("far.net", "/z", None, "block"),
    }
    long = "x" * 200_000
    far = spark.createDataFrame([(1, f"https://Big.net/{long}", f"<p>{long}</p>" + link), (2, "https://www.big.NET/" + long + "/", None), (2, "https://www.big.NET/" + long + "/", None), (3, "ftp://x", "<link rel=canonical href=>" + long)], "page_id long, url string, html string")
    bad = spark.createDataFrame([("b.example.org", "/es/", "block")], "host string, path string, action string")
    assert sorted((r.page_id, r.verdict) for r in url_filter.judge_pages(far, bad.unionByName(rules)).collect()) == [(1, "block"), (2, "block"), (2, "block"), (3, "allow")]
    assert {r.verdict for r in url_filter.judge_pages(far, rules.limit(0)).collect()} == {"allow"}
    empty = docs.limit(0)
    assert url_filter.judge_pages(empty, rules).count() == 0


def test_shards_equal_plain_interleaving(documents, odd_docs, no_docs):
    import hashlib

    for docs, buckets in ((documents, 16), (odd_docs.withColumnRenamed("size", "other"), 3)):
        rows = sharding.interleave(docs.select("doc_id", "source", "text"), ["doc_id", "text"], "source", 8, bucket_rows=buckets).collect()
        n = docs.count()
        assert len(rows) == n
        counts = Counter(r.shard for r in rows)
        assert max(counts.values()) - min(counts.get(s, 0) for s in range(8)) <= 1
        for s in range(8):
            assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
        h = lambda r: hashlib.md5(f"17:{r.doc_id}:{r.text or ''}".encode()).hexdigest()
        frac = {}
        for source in {r.source for r in rows}:
            own = sorted((r for r in rows if r.source == source), key=lambda r: (h(r), r.doc_id))
            for k, r in enumerate(own):
                frac.setdefault(r, []).append((2 * k + 1) / (2 * len(own)))
        order = sorted(((f, r.source is None, r.source or "", h(r), r.doc_id), r) for r, fs in frac.items() for f in fs)
        assert sorted((i * 8 // n, r.doc_id) for i, (_, r) in enumerate(order)) == sorted((r.shard, r.doc_id) for r in rows)
    assert sharding.interleave(no_docs.select("doc_id", "source"), ["doc_id"]).count() == 0
    with pytest.raises(ValueError, match="slot"):
        sharding.interleave(documents.withColumn("Slot", F.lit(1)), ["doc_id"])


def test_ranks_over_many_runs_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 3)
    rows = spark.range(500).select(F.when(F.col("id") % 3 > 0, "a").alias("s"), ((F.col("id") * 37) % 500).alias("v"))
    got = sharding.ranked(rows, ["s"], ["v"], F.floor(F.col("v") / 8), "rank").collect()
    for s in ("a", None):
        assert [r.rank for r in sorted((r for r in got if r.s == s), key=lambda r: r.v)] == list(range(1, 1 + sum(r.s == s for r in got)))


def plain_targets(sizes, weights=(1, 2, 3)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        level = left / sum(w[s] for s in free)
        stop = [s for s in free if level * w[s] > 3 * sizes[s]]
        if not stop:
            return out | {s: level * w[s] for s in free}
        for s in stop:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_mix_meets_targets(request, which):
    docs = request.getfixturevalue(which)
    kept = docs.select("doc_id", "source", "text")
    got = mixing.mix(kept, keep=["doc_id", "source", "text"], group_rows=5).collect()
    again = mixing.mix(kept.repartition(3, "doc_id"), keep=["doc_id", "source", "text"], group_rows=5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    want = plain_targets(sizes)
    for source in sizes:
        own = [r for r in got if r.source == source]
        assert all(r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6 for r in own)
        assert all(r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - want[source]) <= max(r.size for r in own)
    assert mixing.mix(docs.limit(0)).count() == 0
    if which == "odd_docs":
        with pytest.raises(ValueError, match="size"):
            mixing.mix(docs, keep=["doc_id", "SIZE"])
        taken = mixing.take(docs, group_rows=5)
        assert taken.columns == docs.columns
        copies = Counter(r.text for r in taken.collect())
        assert copies == {t: n for t, n in sum((Counter({r.text: r.taken // r.size}) for r in got if r.size), Counter()).items() if n}
        assert mixing.take(docs.limit(0)).count() == 0


def test_targets_with_stopped_sources(spark):
    sizes = {"a": 10, "b": 1, "c": 2, "d": 500, None: 7, "e": 0, "f": 1}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = plain_targets(sizes)
    assert all(abs(r.target - want[r.source]) < 1e-9 for r in rows)
    assert abs(sum(r.target for r in rows) - 521) < 1e-9


def test_pivot_keeps_words_and_means():
    rng = np.random.default_rng(8)
    sizes, shares = rng.integers(1, 50, 12).astype(float), rng.random(12)
    runs = []
    for seed in range(3000):
        out, left = mixing.pivot(np.arange(12), sizes, shares, seed)
        assert abs((out * sizes).sum() - (shares * sizes).sum()) < 1e-6
        assert all(x in (0, 1) for i, x in enumerate(out) if i != left)
        runs.append(out)
    assert np.abs(np.mean(runs, axis=0) - shares).max() < 0.06


def test_crc_of_shards(spark, documents):
    from tickloom.llm.queries import op3_stratified_shards

    got = {r.doc_id: (r.size, r.text_crc32) for r in op3_stratified_shards(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: (len(r.text.encode()) + 16, zlib.crc32(r.text.encode())) for r in documents.collect()}


def test_shards_keep_every_column(spark):
    names = ["doc_id", "source", "__h", "__frac", "__bucket", "__rank", "by", "h", "n", "at", "kept", "rank", "a.b"]
    rows = spark.createDataFrame([(i, f"s{i % 3}" if i % 7 else None, *[f"{k}-{i}" for k in range(len(names) - 2)]) for i in range(400)], ", ".join(f"`{c}` {'long' if c == 'doc_id' else 'string'}" for c in names))
    out = sharding.interleave(rows, ["doc_id"], "source", 7, bucket_rows=16)
    assert out.columns == [*names, "shard", "slot"]
    assert sorted(map(tuple, out.drop("shard", "slot").collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert max(counts) - min(counts) <= 1


def test_equal_rows_are_dealt_to_many_groups(spark, monkeypatch):
    same = spark.range(20_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.lit("one two three").alias("text"))
    docs = same.unionByName(spark.range(20_000).select("id", F.lit("t"), F.lit("four")).toDF("doc_id", "source", "text"))
    keys = []
    real = mixing.rounded
    monkeypatch.setattr(mixing, "rounded", lambda rows, *more: keys.append(rows.where("by.c = 's'").groupBy(F.pmod(F.xxhash64("key", F.lit(29)), F.lit(200))).count().collect()) or real(rows, *more))
    got = [mixing.mix(docs.repartition(n), group_rows=100).where("doc_id = 7").agg(F.sum("taken"), F.first("target")).first() for n in (3, 11)]
    assert [len(k) for k in keys] == [200, 200] and max(r["count"] for k in keys for r in k) < 200
    assert got[0] == got[1] and abs(got[0][0] - got[0][1]) <= 3 + 1e-6
