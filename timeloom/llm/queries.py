"""The contract queries opN_<name>: thin columns over the operators of this subpackage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, byte_bpe, fill_middle, language, mixing, nearest, packing, quality_rules, simhash, suffix_dedup, token_store, toxicity, url_rules
from .common import table

URL_RULES = [
    url_rules.Rule("org", "/", "allow"),
    url_rules.Rule("example.org", "/es/", "block"),
    url_rules.Rule("example.org", "/en/1", "block"),
    url_rules.Rule("com", "/fr/", "allow"),
    url_rules.Rule("com", "/de/", "block"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), URL_RULES).drop("n_candidates")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = byte_bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), round_trip=True)
    return rows.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _remainder(most: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % most


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language.learn(docs.where(_remainder(4) != 2))
    rows = language.identify(docs, profiles, ["doc_id"])
    return rows.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(_remainder(5) != 0))
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", (_remainder(5) == 0).alias("held_out"), "score", "predicted")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """text: what is left, with U+FFFD where a cut splits a character.

    Beside the contract's 400-byte strings: n_passages, passage_bytes and text_without_passages, for maximal repeats of over 50
    words (200 bytes at least), most of which no 400-byte string fits into."""
    rows = suffix_dedup.remove(table(spark, sf_dir, "documents"), ["doc_id"], passage=suffix_dedup.PASSAGE)
    text, other = (F.make_valid_utf8(F.col(c).cast("string")) for c in ("kept_bytes", "kept_passages"))
    contract = ["doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), text.alias("text")]
    return rows.select(*contract, "n_passages", "passage_bytes", other.alias("text_without_passages"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_store.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=1)
    return token_store.read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"])


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.restore(fill_middle.transform(table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filters, op2_byte_bpe, op3_language_id, op4_simhash, op5_toxicity, op6_quality_rules, op7_suffix_dedup, op8_token_output, op9_nearest, op10_packing, op11_mixing, op12_alignment, op13_fill_middle)
}

_URL_PARTS = r"""
SELECT page_id, url,
  CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
  CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
FROM pages
"""

_CUT = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS x FROM documents),
n AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2, CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substring(t, 1, a) AS before, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS after FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', before, '<S>', after, '<M>', middle) ELSE concat('<S>', after, '<P>', before, '<M>', middle) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""

ORACLES = {
    "op13_fill_middle": _CUT,
    "op9_nearest": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
    "op1_url_filters": rf"""
WITH u AS ({_URL_PARTS}),
r(h, p, rule, verdict) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'),
  ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
m AS (SELECT u.page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u JOIN r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY u.page_id)
SELECT u.page_id, u.host, u.path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (page_id)
""",
}
