"""Ranked search, text of pages and alignment against plain versions."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import alignment, html_text, lexical_search, queries
from tickloom.llm.min_cut import _by_flow, min_cut
from tickloom.llm.tokens import vocabulary

# --- ranked search ---------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    n, words, df = len(held), sum(x[2] for x in held), Counter(t for x in held for t in x[1])
    out = []
    for item, text in items:
        scores = []
        for i, tf, own in held:
            m = 75 + 25 * own * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m)) for t in terms(text) if t in tf)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, p, x[3], -x[0]) for p, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=repr)


def listed(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_search_equals_a_plain_ranking(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in items.collect()], 20)
    got = queries.op11_presence_mask_search(spark, sf)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert listed(got) == want and len(want) > 100


def test_search_of_odd_rows_in_small_batches_and_blocks_of_items(spark, odd_docs, monkeypatch):
    monkeypatch.setattr(lexical_search, "ITEMS_AT_ONCE", 3)
    monkeypatch.setattr(lexical_search, "FIRST_DOCS", 1)
    docs = odd_docs.unionByName(odd_docs.where("doc_id in (6, 8)").withColumn("doc_id", F.lit(None).cast("long")))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = [(1, "one two"), (2, "ÉMILE naïve émile same line"), (3, None), (4, " -- "), (None, "a b c d a"), (6, "nowhere"), (7, rows[0][1]), (1, "ONE")]
    items = spark.createDataFrame(asked, "item_id int, text string").withColumn("rank", F.lit("mine"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = listed(lexical_search.search(docs, items, k=3))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # Repeated items keep one ranking each, and equal rows are interchangeable.
    assert got == plain_search(rows, asked, 3)


def test_search_of_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical_search.search(no_docs, items).count() == 0
    assert lexical_search.search(odd_docs, items.limit(0)).count() == 0


def test_search_stops_before_all_documents_and_long_texts_are_cut(monkeypatch):
    rng = np.random.default_rng(3)
    n, size = 4000, 60
    owner = np.repeat(np.arange(n), 5)
    pairs = np.unique(owner * size + np.minimum(rng.geometric(0.08, len(owner)) - 1, size - 1))
    owner, held = pairs // size, pairs % size
    block = lexical_search.Block(np.arange(n), np.zeros(n, bool), np.full(n, 5), held, np.ones(len(held), np.int64), owner, n, 5 * n)
    weights = lexical_search.term_weights(n, np.bincount(held, minlength=size))
    item = lexical_search.Item(0, np.arange(20, 50), np.ones(30, np.int64))
    best = lexical_search.Best(10)
    assert lexical_search.search_block(block, item, weights, best) < n / 4
    want = block.scores(np.searchsorted(block.terms, item.terms), weights[item.terms], np.ones(n, bool))
    assert best.score.tolist() == sorted(want.tolist())[::-1][:10]
    text = (" ".join(f"w{i % 977}" for i in range(50_000)) + " Ünd").encode()
    monkeypatch.setattr(lexical_search, "PIECE_BYTES", 1000)
    assert [x.decode() for run in lexical_search.pieces_of(text) for x in run] == terms(text.decode())


# --- text of pages ---------------------------------------------------------------------------------------------


def test_cuts_equal_the_best_of_all_labellings():
    rng = random.Random(1)
    for _ in range(500):
        n = rng.randint(0, 8)
        lean = [rng.randint(-8, 8) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 5)) for _ in range(rng.randint(0, 2 * n))] if n else []

        def cost(labels, lean=lean, edges=edges):
            return sum(max(0, -x) if s else max(0, x) for x, s in zip(lean, labels, strict=True)) + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(itertools.product([False, True], repeat=n), key=lambda x: (cost(x), -sum(x)))
        assert list(best) == min_cut(lean, edges) == _by_flow(lean, [e for e in edges if e[0] != e[1]])


LONG = "The committee met on Tuesday to discuss the new plan, and after a long debate it was agreed that the work should begin before the end of the year."
MORE = "Several members asked for more time; others said that enough had been spent already, and that every month of delay would cost the town dearly."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact us</a></li></ul>'
PAGES = {
    "article": (f"<html><body><nav>{MENU}</nav><div class='ad'>Buy one, get one free today.</div><article><h1>Plan</h1><p>{LONG}<p>{MORE}</article><footer>&copy; Town &middot; All rights reserved.</footer></body></html>", f"Plan {LONG} {MORE}"),
    "classes": (f"<body><div id=header><div class=logo>The Town Paper</div>{MENU}</div><div class='sidebar'><h3>Most read</h3><p>{LONG}</p></div><div class='post-content'><h2>Plan</h2><p>{LONG}</p><p>Short one.</p><p>{MORE}</p></div><div id='footer'><p>Copyright 2020 The Town Paper. All rights reserved, see our terms of use.</p></div>", f"Plan {LONG} Short one. {MORE}"),
    "ad between": (f"<main><p>{LONG}</p><div class='advert'>Cheap shoes here!</div><p>Yes.</p><aside>{MORE}</aside><p>{MORE}</p><form><label>Mail</label><input><button>Send it now</button></form><section class='comments'><h2>Comments</h2><p>{LONG} I do not agree at all.</p></section></main>", f"{LONG} Yes. {MORE}"),
    "plain": (f"<html><body>{MENU}<p>{LONG}</p><p>{MORE}</p></body></html>", f"{LONG} {MORE}"),
    "cookie": (f"<div class='cookie-notice' role='dialog'><p>We use cookies to give you the best experience on this site and to count its visitors.</p><button>Accept</button></div><article><header><h1>Plan</h1></header><p>{LONG}</p><footer>Posted in News</footer></article>", f"Plan {LONG}"),
    "wrapped": (f"<body class='has-sidebar'><div class='content-with-sidebar'><article><p>{LONG}</p></article><div class='sidebar'>{MENU}</div></div>", LONG),
    "hidden": (f"<article><p>{LONG}</p><div style='display: none'>{MORE}</div><p hidden>{MORE}</p></article>", LONG),
    "references": ("<article><p>Fish &amp; chips &lt;b&gt; caf&eacute; &#8364;5&nbsp;only,\n\n  <b>b</b>old<br>line <!-- no > --> end</p></article>", "Fish & chips <b> café €5 only, bold line end"),
    "scripts": (f"<head><title>T</title><script>if (a < b) document.write('<p>x</p>')</script><style>p {{}}</style></head><article><p title='a > b'>{LONG}</p><script>1</script></article>", LONG),
    "cut off": (f"<nav>{MENU}</nav><article><p>{LONG}</p><p>{MORE} And <a hr", f"{LONG} {MORE} And"),
    "empty": ("", ""),
    "only a menu": (f"<nav>{MENU}</nav>", ""),
    "list": (f"<article><p>{LONG}</p><ul><li>One thing<li>Another <a href='/x'>thing</a></ul><table><tr><td>1<td>2</table></article>", f"{LONG} One thing Another thing 1 2"),
}


@pytest.mark.parametrize("name", PAGES)
def test_text_of_a_page(name):
    assert html_text.main_text(PAGES[name][0]) == PAGES[name][1]


def test_text_of_all_pages(spark, sf):
    got = queries.op12_min_cut_text(spark, sf)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = {}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inner = (r.html or "").partition("<article>")[2].partition("</article>")[0]
        want[r.page_id] = " ".join(html.unescape(re.sub("</?b>", "", re.sub("</?(?:p|h1|br)>", " ", inner))).split())
    rows = got.collect()
    assert {r.page_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows)


def test_text_of_odd_pages(spark):
    rows = [(1, "u", None), (1, None, ""), (None, "u", PAGES["article"][0]), (2, "u", PAGES["article"][0]), (2, "u", "<article>" + f"<div><p>{LONG}" * 20_000), (3, "u", "<a \"'" * 5000 + "<!--"), (4, "u", "plain words, no tags at all")]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumns({"text": F.lit("t"), "n_chars": F.lit("n")})
    got = [r.text for r in html_text.extract(pages).orderBy(F.length("text")).collect()]
    assert len(got) == 7 and got[0] == "" and got[-1] == " ".join([LONG] * 20_000) and got.count(PAGES["article"][1]) == 2
    assert html_text.extract(pages.limit(0)).count() == 0
    assert html_text.learned_shapes(pages.limit(0)) == html_text.SHAPES


def test_shapes_are_learned_from_pages(spark):
    pages = spark.createDataFrame([(f"<nav>{MENU}</nav><article>{f'<li>{LONG}' * 5}</article>",)] * 200, "html string")
    found = html_text.learned_shapes(pages)
    assert found["kind"]["item"] > found["kind"]["other"] or found["words"]["25"] > 1.5
    assert found["words"]["25"] > found["words"]["1"] and found["links"]["most"] < found["links"]["none"]
    assert all(abs(v) <= html_text.MOST for x in found.values() for v in x.values())


# --- alignment -------------------------------------------------------------------------------------------------


def test_merge_pieces_find_all_common_ends():
    rng = random.Random(5)
    for k in range(300):
        top = rng.randint(1, 60)
        a, b = (np.array(sorted(rng.sample(range(top), rng.randint(0, top))), np.int64) for _ in range(2))
        i, j = alignment.common_ends(a, b, piece=rng.randint(1, 9))
        assert a[i].tolist() == b[j].tolist() == sorted({*a.tolist()} & {*b.tolist()})
        cuts = np.arange(0, len(a) + len(b) + 1)
        merged = sorted([(x, 0) for x in a.tolist()] + [(x, 1) for x in b.tolist()])
        assert alignment.merge_path(a, b, cuts).tolist() == [sum(s == 0 for _, s in merged[:d]) for d in cuts.tolist()]


@pytest.fixture(scope="module")
def pair():
    return alignment.Tokenizers(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), None)


def plain_alignment(rows, t):
    found, counts = [], Counter()
    for doc, text in rows:
        a = t.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = t.b.encode(text) if text else []
        if any(b"".join(x[i] for i in ids) != (" " + (text or "")).encode() for x, ids in ((t.a_bytes, a), (t.b_bytes, b))):
            found.append((doc, [], [], [], ""))
            continue
        ends, at = {}, 0
        for k, i in enumerate(a):
            at += len(t.a_bytes[i])
            ends[at] = k
        at, links, groups, la, lb = 0, [], [], 0, 0
        for k, i in enumerate(b):
            at += len(t.b_bytes[i])
            if at in ends:
                links.append((a[ends[at]], i))
                groups.append(",".join(map(str, a[la : ends[at] + 1])) + "|" + ",".join(map(str, b[lb : k + 1])))
                la, lb = ends[at] + 1, k + 1
        counts.update(links)
        found.append((doc, a, b, links, ";".join(groups)))
    most: dict[int, int] = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    return sorted([(doc, len(a), len(b), len(x), len(x), sum(counts[y] == most[y[1]] for y in x), sum(counts[y] for y in x), hashlib.sha256(g.encode()).hexdigest() if a else "") for doc, a, b, x, g in found], key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_equals_a_plain_one(spark, sf, documents, pair):
    got = queries.op13_merge_path_alignment(spark, sf)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=repr) == plain_alignment([(r.doc_id, r.text) for r in documents.collect()], pair)


def test_alignment_of_odd_rows_and_rare_pairs(spark, odd_docs, no_docs, pair, monkeypatch):
    more = [(20, "<s> x </s> <|endoftext|>"), (21, "▁z is no space"), (22, "  two  blanks \n\t and \r\n lines "), (23, "漢字 かな Ελλάδα русский \U0001f600‍\U0001f600 á"), (24, "\x00 nul \x1c"), (None, "one two"), (25, " "), (26, "don't I'll 'S a_b 1234567")]
    docs = odd_docs.select("doc_id", "text", "row", "key").unionByName(spark.createDataFrame(more, "doc_id long, text string").withColumns({"row": F.lit("r"), "key": F.lit("k")}))
    want = plain_alignment([(r.doc_id, r.text) for r in docs.collect()], pair)
    assert sorted(map(tuple, alignment.align_corpus(docs, listed=40).collect()), key=repr) == want
    assert sorted(map(tuple, alignment.align_corpus(docs, listed=0).collect()), key=repr) == want
    assert alignment.align_corpus(no_docs).count() == 0
    kept = alignment.align_corpus(docs, keep_groups=True).where("doc_id = 0").first()
    assert hashlib.sha256(kept.groups.encode()).hexdigest() == kept.groups_sha256


def test_long_texts_are_cut_where_no_token_crosses(documents, pair, monkeypatch):
    text = " ".join(r.text or "" for r in documents.limit(40).collect())
    whole = pair.encode([text])[0]
    monkeypatch.setattr(alignment, "RUN_CHARS", 500)
    assert len(pair.runs(text)) > 50
    assert all(x.tolist() == y.tolist() for x, y in zip(whole, pair.encode([text])[0], strict=True))
    fast = alignment.Tokenizers(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"))
    assert fast.encode([text])[0][0].tolist() == whole[0].tolist()
    odd = "".join(map(chr, range(1, 0x250))) + " x’s … —dash €5"
    assert fast.encode([odd])[0][0].tolist() == pair.a.encode(" " + odd, add_special_tokens=False).ids
