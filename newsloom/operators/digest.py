"""Daily digests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.articles import newest_first, recent_articles
from newsloom.operators.tables import checkpointed


def daily_digest(articles: DataFrame, as_of: Column, days: int = 7, per_theme: int = 5) -> DataFrame:
    """(theme, articles): the most important recent articles of each category, the newest first among equals."""
    own = recent_articles(articles, as_of, days, None).withColumn("theme", F.coalesce(F.nullif("category", F.lit("")), F.lit("general")))
    at = Window.partitionBy("theme").orderBy(*newest_first(F.desc("importance")))
    top = own.withColumn("pos", F.row_number().over(at)).where(F.col("pos") <= per_theme)
    return top.groupBy("theme").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "title", "importance"))).alias("articles")).orderBy("theme")


def digest_reply(themes: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """(overview, summaries, error): one row of what ``complete`` says of all themes, given as JSON, or why there is nothing.

    Themes are few, as categories are. ``summaries``: array of (name, summary). Fences around the reply's object are forgiven.
    """
    headlines = F.transform("articles", lambda a: F.struct(a["title"].alias("title"), a["importance"].alias("importance")))
    asked = themes.agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("theme").alias("name"), headlines.alias("headlines"))))).alias("body"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for body in frame["body"]:
                try:
                    yield pd.DataFrame({"text": [complete(body)], "error": [None]})
                except Exception as e:  # noqa: BLE001  the user's function may fail in any way
                    yield pd.DataFrame({"text": [None], "error": [str(e) or type(e).__name__]})

    replies = checkpointed(asked.mapInPandas(run, "text string, error string"))
    said = F.from_json(F.regexp_extract("text", r"(?s)(\{.*\})", 1), "struct<overview:string,themes:array<struct<name:string,summary:string>>>")
    read = replies.withColumn("s", said)
    empty = F.array().cast("array<struct<name:string,summary:string>>")
    unread = F.col("error").isNull() & F.col("s.overview").isNull() & F.col("s.themes").isNull()
    return read.select(F.coalesce("s.overview", F.lit("")).alias("overview"), F.coalesce("s.themes", empty).alias("summaries"), F.when(unread, "no object in the reply").otherwise(F.col("error")).alias("error"))


def enrich_digest(themes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Themes with the summary of the same name, whatever its case; without one it is empty."""
    own = summaries.groupBy(F.lower("name").alias("_n")).agg(F.min("summary").alias("summary"))
    return themes.join(own, F.lower("theme") == F.col("_n"), "left").drop("_n").withColumn("summary", F.coalesce("summary", F.lit("")))
