"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import alignment, fingerprints, html_text, language_model, lexical_search, mixing, near_dedup, packing, quality_rules, rans, separator_scan, sharding, url_filter
from tickloom.llm.common import file_row, new_folder, table

URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_gated_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"))


def op2_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "rans")
    rans.write_ids(table(spark, sf_dir, "documents"), folder)
    return rans.read_ids(spark, folder)


def op3_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.interleave(rows, ["doc_id", "text_crc32"], "source", 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return near_dedup.near_duplicates(docs, file_row(docs))


def op6_one_permutation_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op7_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "flat")
    separator_scan.write_flat(table(spark, sf_dir, "documents"), folder)
    return separator_scan.named(spark, folder, separator_scan.token_counts(spark, folder))


def op9_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_filter.judge_pages(table(spark, sf_dir, "pages"), rules)


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", "judged.*")


def op11_presence_mask_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op13_merge_path_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_corpus(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    dealt = (op1_gated_language_model, op2_rans_files, op3_stratified_shards, op4_pivotal_mix, op5_circulant_minhash, op6_one_permutation_minhash, op7_bin_slack_packing, op8_separator_scan, op9_redirect_equivalence, op10_decision_list, op11_presence_mask_search, op12_min_cut_text, op13_merge_path_alignment, pipeline)
    return {f.__name__: f for f in dealt}


OP9_SQL = r"""WITH RECURSIVE own AS (SELECT DISTINCT url, html FROM pages WHERE url IS NOT NULL),
bare AS (SELECT *, translate(regexp_extract(short, '(?s)^.*?://[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(short, length(regexp_extract(short, '(?s)^.*?://[^/?#]*')) + 1) AS canonical FROM (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])(?:(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*(?:&|$))+', '\1', 'g'), '[?&]$', ''), '^(?i:https?)://(?i:www\.|m\.)?', 'https://'), '(?:/index)?(?:\.html?)?/?(\?|$)', '\1', 'g') AS short,
  regexp_extract(regexp_extract(html, '(?is)<link\b[^>]*\brel=["'']?canonical\b[^>]*>'), '(?is)\bhref=["'']?([a-z]+://[^"''\s>]+)', 1) AS link, regexp_extract(regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv=["'']?refresh\b[^>]*>'), '(?is)\burl=["'']?([a-z]+://[^"''\s>]+)', 1) AS refresh FROM own WHERE contains(url, '://'))),
edge AS (SELECT DISTINCT url AS a, b FROM (SELECT url, unnest([canonical, link, refresh]) AS b FROM bare) WHERE b <> '' AND b <> url),
sides AS MATERIALIZED (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(url, node) AS (SELECT DISTINCT a, a FROM sides UNION SELECT r.url, s.b FROM reach r JOIN sides s ON s.a = r.node),
node AS (SELECT url FROM own UNION SELECT b FROM edge),
split AS (SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM node),
rules(h, p, action) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fit AS (SELECT url, h || p AS rule, action FROM split JOIN rules ON host <> '' AND (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(h || p) DESC, action) = 1),
hit AS (SELECT DISTINCT r.url FROM reach r JOIN fit f ON f.url = r.node AND f.action = 'block')
SELECT page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, f.rule, coalesce(f.action, CASE WHEN h.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN split s ON s.url = p.url LEFT JOIN fit f ON f.url = p.url LEFT JOIN hit h ON h.url = p.url"""


OP11_SQL = r"""WITH word AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
ask AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
doc AS (SELECT doc_id, count(*) AS own FROM word GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(own) AS BIGINT) AS words FROM doc),
held AS (SELECT doc_id, term, count(*) AS tf FROM word WHERE term IN (SELECT term FROM ask) GROUP BY ALL),
weight AS (SELECT term, CAST(floor(1000*ln((2*any_value(docs)+2)/(2*count(*)+1))) AS BIGINT) AS w FROM held, total GROUP BY term),
hit AS (SELECT item_id, doc_id, CAST(sum(times*w*((1000000000*tf)//(1000*tf+12*(75+(25*own*docs)//words)))) AS BIGINT) AS score FROM ask JOIN weight USING (term) JOIN held USING (term) JOIN doc USING (doc_id), total GROUP BY item_id, doc_id)
SELECT item_id, CAST(place AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM hit WHERE score > 0) WHERE place <= 20"""


def oracle_sql() -> dict[str, str]:
    return {"op9_redirect_equivalence": OP9_SQL, "op11_presence_mask_search": OP11_SQL}
