"""Token files, scans and packing against the tokenizer run over whole texts."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tickloom.llm import packing, queries, rans, separator_scan, words
from tickloom.llm.common import new_folder
from tickloom.llm.tokens import vocabulary


def whole_ids(text, end):
    from tokenizers import Tokenizer

    whole_ids.t = getattr(whole_ids, "t", None) or Tokenizer.from_file(vocabulary())
    return [*whole_ids.t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_rans_round_trip_in_doc_order(spark, request, which):
    docs = request.getfixturevalue(which)
    folder = new_folder(spark, "t")
    rans.write_ids(docs, folder, segment_ids=3000)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rans.read_ids(spark, folder).collect())
    want, start = [], 0
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text or "")):
        ids = whole_ids(r.text, 2)
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == sorted(want)


def test_rans_parts_decode_alone_and_checksums_hold():
    ids = np.random.default_rng(3).zipf(1.3, 300_000).clip(0, 49_000).astype(np.uint16)
    made = rans.encode_segment(ids)
    assert (rans.decode_segment(made) == ids).all()
    table = rans.Table(np.frombuffer(made["symbols"], "<u2"), np.frombuffer(made["freqs"], "<u4"))
    step = rans.LANES * rans.STEPS_PER_CHECKPOINT
    assert (rans.decode_part(made["blocks"][0], table, 1) == ids[step : 2 * step]).all()
    assert len(b"".join(b["code"] for b in made["blocks"])) < 2 * len(ids)
    broken = dict(made["blocks"][0], sums=[1, 2, 3])
    with pytest.raises(ValueError, match="checksum"):
        rans.decode_part(broken, table, 0)


def test_rans_of_nothing(spark, no_docs):
    folder = new_folder(spark, "t")
    rans.write_ids(no_docs, folder)
    assert rans.read_ids(spark, folder).count() == 0


@pytest.mark.parametrize("which", ["documents", "odd_docs"])
def test_separator_scan_finds_every_document(spark, request, which):
    docs = request.getfixturevalue(which)
    folder = new_folder(spark, "t")
    separator_scan.write_flat(docs, folder, block_ids=700)
    got = separator_scan.named(spark, folder, separator_scan.token_counts(spark, folder)).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((r.doc_id, len(whole_ids(r.text, 0))) for r in docs.collect())
    by_file = {}
    for r in sorted(got, key=lambda r: (r.file, r.ordinal)):
        ordinal, start = by_file.get(r.file, (0, 0))
        assert (r.ordinal, r.start) == (ordinal, start)
        by_file[r.file] = (ordinal + 1, start + r.n_tokens)


def test_separator_scan_keeps_documents_that_hold_the_end_marker(spark, odd_docs):
    marked = [(20, "<|endoftext|>"), (21, "one two"), (22, "a <|endoftext|> b<|endoftext|>"), (23, "three"), (24, None)]
    docs = odd_docs.select("doc_id", "text").unionByName(spark.createDataFrame(marked, "doc_id long, text string"))
    for size in (5, 1 << 18):
        folder = new_folder(spark, "t")
        separator_scan.write_flat(docs.coalesce(1), folder, block_ids=size)
        got = separator_scan.named(spark, folder, separator_scan.token_counts(spark, folder)).collect()
        assert sorted((r.doc_id, r.n_tokens) for r in got) == sorted((r.doc_id, len(whole_ids(r.text, 0))) for r in docs.collect())
    with pytest.raises(Exception, match="in the vocabulary"):
        separator_scan.write_flat(docs, new_folder(spark, "t"), end_id=49407)


def test_separator_scan_of_nothing_and_of_repeated_rows(spark, no_docs):
    for docs in (no_docs, spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")):
        folder = new_folder(spark, "t")
        separator_scan.write_flat(docs, folder)
        got = separator_scan.named(spark, folder, separator_scan.token_counts(spark, folder)).collect()
        assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(((r.doc_id, len(whole_ids(r.text, 0))) for r in docs.collect()), key=str)


def check_packing(docs, got, capacity=2048):
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(whole_ids(r.text, 1))
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc, texts in want.items():
        found = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc])
        assert found == sorted((s, len(t[s : s + capacity]), crc(t[s : s + capacity]), len(t)) for t in texts for s in range(0, len(t), capacity))
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences) - -(-sum(r.length for r in got) // capacity)


def test_packing_takes_at_most_one_window_over_the_least(documents):
    got = packing.pack(documents).collect()
    assert check_packing(documents, got) <= 1


def test_packing_odd_rows(odd_docs, no_docs):
    check_packing(odd_docs, packing.pack(odd_docs, group_rows=4).collect())
    assert packing.pack(no_docs).count() == 0


def test_best_fill_equals_exhaustive_search():
    rng = np.random.default_rng(5)
    for _ in range(60):
        lengths = rng.integers(1, 30, 9)
        counts, seed = np.bincount(lengths, minlength=61), int(lengths.max())
        rest = list(lengths)
        rest.remove(seed)
        best = max(s for k in range(1 << len(rest)) if (s := seed + sum(x for i, x in enumerate(rest) if k >> i & 1)) <= 60)
        taken = packing.best_fill(counts, 60, seed)
        assert sum(x * n for x, n in taken) == best
        assert all(n <= counts[x] for x, n in taken)


def test_rows_without_ids_fill_many_files(spark, tmp_path):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text")).unionByName(spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text")))
    rans.write_ids(docs, str(tmp_path / "f"))
    held = [len(r.doc_ids) for r in spark.read.parquet(str(tmp_path / "f")).collect()]
    assert sum(held) == 6000 and max(held) < 2000
    got = rans.read_ids(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 4000 + [1] * 2000
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False))


def test_queries_return_the_columns_of_their_contracts_in_order(spark, sf):
    columns = {
        "op2_rans_files": ["doc_id", "start", "n_tokens", "ids_crc32"], "op3_stratified_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op4_pivotal_mix": ["doc_id", "size", "source_size", "target", "taken"], "op7_bin_slack_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        "op9_redirect_equivalence": ["page_id", "host", "path", "rule", "verdict"], "op10_decision_list": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    }
    for name, want in columns.items():
        assert queries.queries()[name](spark, sf).columns[: len(want)] == want, name


def test_words_of_a_long_text_take_bounded_memory():
    import tracemalloc

    text = (b"some Words of a long text, again " * 640_000)[:20_000_000]
    few = words.words_of([text[:3_000_000]], True)
    tracemalloc.start()
    many = words.words_of([b"", text, b"x y"], True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)
    assert many.count.tolist()[0::2] == [0, 2] and (many.hash[: len(few.hash) - 1] == few.hash[:-1]).all()
    assert many.joined[many.start[-2] : many.end[-2]].tobytes() == b"x"
    long = words.words_of([b"a " + b"y" * 5_000_000 + b" b"], False)
    assert long.count.tolist() == [3] and len(words._powers[0]) == 2 * words.PIECE


def test_plain_files_of_anything_are_scanned(spark, tmp_path):
    rng, want, end = np.random.default_rng(4), {}, separator_scan.END_ID
    (tmp_path / "plain").mkdir()
    for name in "abc":
        sizes = [int(x) for x in rng.integers(1, 90, 40)] + [1, 1, 3000, 1]
        docs = [np.append(rng.integers(0, 49_000, n - 1), end) for n in sizes]
        tail = rng.integers(0, 49_000, 17 if name == "b" else 0)  # ids after the last end are no document
        np.concatenate([*docs, tail]).astype("<u2").tofile(tmp_path / "plain" / name)
        want[name] = [(k, sum(sizes[:k]), n) for k, n in enumerate(sizes)]
    (tmp_path / "plain" / "empty").write_bytes(b"")
    for block in (64, 1000, 1 << 18):
        found = separator_scan.stitched(separator_scan.scan_plain(spark, str(tmp_path / "plain"), block_ids=block)).collect()
        got = {name: sorted((r.ordinal, r.start, r.n_tokens) for r in found if r.file.endswith("/" + name)) for name in want}
        assert got == want and len(found) == sum(map(len, want.values()))
    (tmp_path / "plain" / "odd").write_bytes(b"abc")
    with pytest.raises(Exception, match="16-bit"):
        separator_scan.scan_plain(spark, str(tmp_path / "plain")).count()
