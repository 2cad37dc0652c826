"""Importance adjustments learned from reader events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import domain_pattern
from newsloom.operators.articles import since
from newsloom.operators.tables import upsert

DROP, STAR, RESCUE, SUGGEST = 0.7, 0.2, 0.05, 0.85


def article_verdicts(articles: DataFrame, events: DataFrame, as_of: Column, window_days: int = 90) -> DataFrame:
    """(id, source_id, tags, is_read, archived, starred) of articles fetched in the window with an event of a user."""
    seen = events.where("actor = 'user'").groupBy("article_id").agg(*[F.bool_or(F.col("event") == e).alias(n) for e, n in (("read", "is_read"), ("archived", "archived"), ("starred", "starred"))])
    own = articles.where(since("fetched_at", as_of, window_days)).select("id", "source_id", "tags")
    return own.join(seen, own.id == seen.article_id).drop("article_id")


def signals(verdicts: DataFrame, sources: DataFrame, min_samples: int = 20, max_delta: int = 1) -> DataFrame:
    """Rates and the bounded delta of every source and tag; a tag that an article repeats counts as often."""
    by_source = verdicts.select(F.lit("source").alias("kind"), F.col("source_id").cast("string").alias("key"), "is_read", "archived", "starred")
    by_tag = verdicts.select(F.lit("tag").alias("kind"), F.explode("tags").alias("key"), "is_read", "archived", "starred").where("key <> ''")
    rate = lambda c: F.count_if(c) / F.count("*")
    out = by_source.unionByName(by_tag).groupBy("kind", "key").agg(
        F.count("*").alias("samples"), rate(F.col("is_read")).alias("read_rate"), rate(F.col("archived") & ~F.col("is_read")).alias("drop_rate"), rate(F.col("starred")).alias("star_rate")
    )
    delta = F.when(F.col("samples") < min_samples, 0).when(F.col("star_rate") >= STAR, max_delta).when((F.col("drop_rate") >= DROP) & (F.col("star_rate") < RESCUE), -max_delta).otherwise(0)
    names = sources.select(F.lit("source").alias("kind"), F.col("id").cast("string").alias("key"), F.col("name").alias("label"))
    return out.join(names, ["kind", "key"], "left").withColumns({"label": F.coalesce("label", "key"), "delta": delta})


def store_signals(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New signals over stored ones; signals that are no longer produced stay."""
    return upsert(stored, new, ["kind", "key"]).drop("created")


def adjustment_for(articles: DataFrame, learned: DataFrame, max_delta: int = 1) -> DataFrame:
    """(id, delta): the sum over an article's source and tags, within the bound."""
    moved = learned.where("delta <> 0").select("kind", "key", "delta")
    keys = articles.select("id", F.explode(F.concat(F.array(F.struct(F.lit("source").alias("kind"), F.col("source_id").cast("string").alias("key"))), F.transform("tags", lambda t: F.struct(F.lit("tag").alias("kind"), t.alias("key"))))).alias("k"))
    total = keys.select("id", "k.*").join(moved, ["kind", "key"], "left").groupBy("id").agg(F.coalesce(F.sum("delta"), F.lit(0)).alias("d"))
    return total.select("id", F.greatest(F.lit(-max_delta), F.least(F.lit(max_delta), F.col("d"))).cast("int").alias("delta"))


def suggest_rules(learned: DataFrame, sources: DataFrame, least_drop: float = SUGGEST) -> DataFrame:
    """Disabled archive rules for sources that readers throw away."""
    own = learned.where((F.col("kind") == "source") & (F.col("delta") < 0) & (F.col("drop_rate") >= least_drop))
    named = own.join(sources.select(F.col("id").cast("string").alias("key"), "url"), "key")
    return named.select(F.concat(F.lit("learned: "), F.col("label")).alias("name"), domain_pattern(F.col("url")).alias("query"), F.lit(False).alias("enabled")).where("query <> ''")


def signal_report(learned: DataFrame, min_samples: int = 20) -> DataFrame:
    verdict = F.when(F.col("delta") > 0, F.concat(F.lit("+"), F.col("delta"), F.lit("  you keep these"))).when(F.col("delta") < 0, F.concat(F.col("delta"), F.lit("  you throw these away"))).when(F.col("samples") < min_samples, "not enough yet").otherwise("—")
    return learned.select("kind", "label", "samples", verdict.alias("verdict"))
