"""From raw documents to training tokens: five stages, each reading what the last one wrote.

Quality rules and the quality classifier drop what they reject, SimHash keeps one
document of each near-duplicate group, the sources are mixed to their target
weights, and the mixed corpus is encoded with merge-dropout, each copy of a document
by a segmentation of its own. The two models are fitted on a bounded sample of the labelled rows of the whole ``documents`` table,
since an earlier stage has dropped most poor examples from its output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from kvspark.llm import mixing, quality_classifier, quality_rules, sentencepiece_codec, simhash
from kvspark.llm.queries import MIX_SEED, OTHER, TARGETS, table
from kvspark.llm.work import removed, scratch


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def apply_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep(docs, quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.first_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs, TARGETS, OTHER, MIX_SEED)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of a document are numbered, so that each gets its own segmentation; equal rows, so any numbering gives the same rows."""
    copies = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0))
    named = docs.filter("doc_id is not null").select("doc_id", "text", F.row_number().over(copies).alias("copy"))
    nameless = docs.filter("doc_id is null").select("doc_id", "text", F.lit(1).alias("copy"))
    return sentencepiece_codec.encode(named.unionByName(nameless), number="copy")


STAGES = [
    ("quality rules", apply_quality_rules),
    ("quality classifier", apply_quality_classifier),
    ("SimHash near-dedup", drop_near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_texts),
]

#: The trained stages can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's output is written as Parquet in the shared folder and read again.

    A stage's output is removed once its successor's is written.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        out = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            removed(spark, before)
        before = out
    return docs
