"""Figures of where things stand: one row each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _beside(*rows: DataFrame) -> DataFrame:
    """Tables of one row as one row."""
    return reduce(lambda a, b: a.join(b.withColumn("_one", F.lit(1)), "_one"), rows[1:], rows[0].withColumn("_one", F.lit(1))).drop("_one")


def pipeline_flow(articles: DataFrame, sources: DataFrame, notes: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counts behind each stage: visible sources, articles (copies included), notes by type, and notes and articles with a vector (kind, id)."""
    n = F.count_if
    counted = articles.agg(F.count("*").alias("articles"), n("classified").alias("classified"), n((F.col("status") != "archived") & ~F.col("classified")).alias("pending"))
    shown = sources.where("NOT hidden").agg(F.count("*").alias("sources"), n("enabled").alias("enabled"))
    kinds = notes.agg(*[n(F.col("note_type") == k).alias(f"{k}s") for k in ("atom", "electron", "molecule")])
    embedded = [rows.select("id").join(vectors.where(F.col("kind") == kind).select("id"), "id", "left_semi").agg(F.count("*").alias(f"{kind}s_embedded")) for kind, rows in (("note", notes), ("article", articles))]
    return _beside(shown, counted, kinds, *embedded)


def status(articles: DataFrame, notes: DataFrame, unhealthy: DataFrame) -> DataFrame:
    """Unread and all articles, notes, articles that wait for classification, and unhealthy sources."""
    counted = articles.agg(F.count_if(F.col("status") == "unread").alias("unread"), F.count("*").alias("total"), F.count_if((F.col("status") != "archived") & ~F.col("classified")).alias("pending"))
    return _beside(counted, notes.agg(F.count("*").alias("notes")), unhealthy.agg(F.count("*").alias("unhealthy")))
