"""Single pages taken in as articles, and bodies of articles filled from pages that have landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.markdown import clean_markdown, extract_pages
from newsloom.functions.text import extract_links, trimmed
from newsloom.operators.articles import extract_pending
from newsloom.operators.tables import upsert

MANUAL = "Manual"
#: What a feed may not take back from a stored article: the reader's doings, and what later steps have found out.
KEPT = ("status", "starred", "classified", "extracted", "story_id", "fetched_at")


def with_manual_source(sources: DataFrame) -> DataFrame:
    """``sources`` (id, name, type, group_name, enabled, hidden and others) with the hidden source that single pages belong to."""
    have = sources.where(F.col("name") == MANUAL).select(F.lit(True).alias("_have")).limit(1)
    values = {"name": F.lit(MANUAL), "type": F.lit("manual"), "group_name": F.lit("manual"), "enabled": F.lit(False), "hidden": F.lit(True)}
    last = sources.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("_id")).join(have, F.lit(True), "left_anti")
    new = last.select(*[values.get(f.name, F.col("_id") if f.name == "id" else F.lit(None)).cast(f.dataType).alias(f.name) for f in sources.schema.fields])
    return sources.unionByName(new)


def ingest_pages(pages: DataFrame, articles: DataFrame, sources: DataFrame, least: int = 1) -> DataFrame:
    """(source_id, guid, url, title, author, content_html, content_md, status) of pages (page_id, url, html) whose url no article has.

    They belong to the hidden source. Of a url that comes twice the first page counts; a page whose readable body is under ``least`` characters isn't
    taken in; without a title the url stands for it.
    """
    named = pages.withColumn("url", trimmed(F.col("url"))).where("url <> ''")
    first = named.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    read = extract_pages(first.join(articles.select("url"), "url", "left_anti").withColumn("content_html", F.col("html")), least=least).where("outcome = 'extracted'")
    manual = F.broadcast(sources.where(F.col("name") == MANUAL).select(F.col("id").alias("source_id")).limit(1))
    title = F.coalesce(F.nullif(trimmed(F.col("title")), F.lit("")), "url")
    return read.join(manual, F.lit(True)).select("source_id", F.sha2("url", 256).alias("guid"), "url", title.alias("title"), trimmed(F.col("byline")).alias("author"), "content_html", F.col("markdown").alias("content_md"), F.lit("unread").alias("status"))


def upsert_articles(stored: DataFrame, incoming: DataFrame, as_of: Column) -> DataFrame:
    """``stored`` articles after ``incoming`` ones (source_id, guid and other columns), with ``created``.

    What is new gets ``as_of`` as fetched_at and updated_at. What is known takes the new values and updated_at, but keeps ``KEPT``. Rows that
    don't come in stay as they are.
    """
    stamped = incoming.withColumns({"fetched_at": as_of, "updated_at": as_of})
    return upsert(stored, stamped, ["source_id", "guid"], keep=KEPT)


def extract_landed(articles: DataFrame, pages: DataFrame, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """(articles, done) after the pending queue has been read from landed pages (url, html): bodies and the mark where a page could be read.

    Only pages of articles in the queue are read. What fails stays in the queue. ``done``: one row with the number of those read.
    """
    queue = articles.where(~F.col("extracted") & (F.length("content_md") < least)).select("url").distinct()
    read = extract_pages(pages.join(queue, "url", "left_semi").select("url", "html"), least=least)
    after = extract_pending(articles, read, least)
    was = articles.select("id", F.col("extracted").alias("_was"))
    done = after.join(was, "id").agg(F.count_if(F.col("extracted") & ~F.col("_was")).alias("extracted"))
    return after, done


def read_article(articles: DataFrame) -> DataFrame:
    """Articles as a reader opens them: with their markdown cleaned."""
    return articles.withColumn("content_md", clean_markdown(F.col("content_md")))


def article_links(articles: DataFrame, notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, place, kind, title, target) of what an article (id, url, content_md) leads to: its own url, the links of its body but for that, and what its note is linked with.

    ``notes``: (article, note_id) of articles that have a note; ``edges``: (note, other, direction, title) of notes. Links come in this order.
    """
    own = articles.where("url <> ''").select("id", F.lit(0).alias("part"), F.lit(0).alias("n"), F.lit("external").alias("kind"), F.col("url").alias("title"), F.col("url").alias("target"))
    body = articles.select("id", "url", F.posexplode(extract_links(F.coalesce("content_md", F.lit("")))).alias("n", "l")).where("NOT (l.url <=> url)")
    body = body.select("id", F.lit(1).alias("part"), "n", F.lit("external").alias("kind"), F.col("l.text").alias("title"), F.col("l.url").alias("target"))
    linked = notes.join(edges, F.col("note_id") == F.col("note")).select(F.col("article").alias("id"), F.when(F.col("direction") == "out", 2).otherwise(3).alias("part"), F.col("other").cast("int").alias("n"), F.lit("note").alias("kind"), "title", F.col("other").cast("string").alias("target"))
    every = own.unionByName(body).unionByName(linked)
    return every.select("id", F.struct("part", "n").alias("place"), "kind", "title", "target")
