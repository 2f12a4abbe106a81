"""The corpus pipeline: five stages over documents, each one of the operators of the subpackage for training text.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; docs has the columns of documents. The last
gives the pieces of packed sequences. Learned parts (decision list, language profiles) are fitted anew on each stage's own input,
on the bounded samples that the operators document.

Defined cases: documents without words go in the first stage. In the third, rows without a doc_id are documents, and a doc_id with
several texts is as many; of near copies the row with the least id stays, one without an id only where none has one. A text that
repeats elsewhere as a whole is left empty by the fourth stage, not dropped; a character that a cut splits becomes U+FFFD.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timeloom.llm import language, near_copies, packing, quality_rules, suffix_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text at this distance from every profile is in none of the languages. Of 10,000 documents of sf0.1 none is farther than 0.62
#: from its own; Turkish and Polish prose is at 0.76, other scripts at 1.
FOREIGN = 0.7


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go."""
    rules = quality_rules.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.judge(docs, rules, COLUMNS).where("kept").select(*COLUMNS)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from every learned language, go; `lang` is the predicted language from here on."""
    rows = language.identify(docs, language.learn(docs), COLUMNS)
    return rows.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("distance") < FOREIGN)).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with 0.8 or more of their five-word shingles in common the one with the least id stays."""
    return near_copies.keep_first(docs, COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words (200 bytes at least) that stand anywhere else as well are cut out."""
    rows = suffix_dedup.remove(docs, ["doc_id", "lang", "source"], length=None, passage=suffix_dedup.PASSAGE)
    text = F.make_valid_utf8(F.col("kept_passages").cast("string"))
    return rows.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2)


STAGES = [
    ("quality rules", quality),
    ("language ID", languages),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; the rows are those of the last."""
    from timeloom.llm.common import store

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = store(docs, "stage")
    return docs
