"""The training-data pipeline over ``documents``: classifier, quality rules, near-duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The filtering stages return
the columns of ``documents`` unchanged; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed, table, unused
from newsloom.llm.decontaminate import find_contamination
from newsloom.llm.packing import pack
from newsloom.llm.quality_classifier import fit_quality_classifier, score_quality
from newsloom.llm.quality_rules import apply_rules
from newsloom.llm.simhash_dedup import near_duplicates

def _filtered(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], keep: str, *own: str) -> DataFrame:
    """Rows that ``judge`` marks to keep, as they came: columns of ``docs`` that are named like the judge's ``own`` step aside meanwhile."""
    aside = {c: f"_in_{c}" for c in docs.columns if c.lower() in own}
    judged = judge(docs.withColumnsRenamed(aside)).where(keep)
    return judged.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be of label 1, whatever their length."""
    classifier = fit_quality_classifier(docs, table(spark, sf_dir, "labels"))
    return _filtered(docs, lambda df: score_quality(df, classifier), "predicted = 1", "score", "predicted")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the plain rules and their language's perplexity band."""
    own = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "log_perplexity", "base_failed", "kept")
    return _filtered(docs, apply_rules, "kept", *own)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: that of smallest doc_id, nulls last, then by its text's MD5.

    Rows are known by their place in ``docs``, so null and repeated ids name no other document; of rows equal in
    doc_id and text, the first is left. ``docs`` must have its rows in the same places each time it is read, as
    files and checkpoints have.
    """
    row, key = unused(docs.columns, "_row", "_key")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    own = numbered.select(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", digest.alias("digest"), F.col(row).alias("row")).alias(key), "text")
    named = near_duplicates(own, key=key)
    kept = named.where(F.col(key) == F.col("component_id")).select(F.col(f"{key}.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    own = ("n_words", "n_hit", "n_items", "items", "spans", "items_sha256", "contaminated")
    return _filtered(docs, lambda df: find_contamination(df, table(spark, sf_dir, "benchmark")), "NOT contaminated", *own)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, packed into sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: Trained models, hashes and tokens can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is cut from its lineage before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpointed(docs)
    return docs
