"""Article lists, queues and state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.tables import apply_changes

STATUSES = ("unread", "read", "archived")


def is_anchor() -> Column:
    return (F.col("story_id") == 0) | (F.col("story_id") == F.col("id"))


def newest_first(*first: Column) -> list[Column]:
    """By publication, unknown last, then by arrival and id."""
    return [*first, F.desc_nulls_last("published"), F.desc("fetched_at"), F.col("id")]


def since(column: str, as_of: Column, days: int) -> Column:
    return F.col(column) >= as_of - F.make_dt_interval(F.lit(days))


def list_articles(
    articles: DataFrame, sources: DataFrame, *, status: str | None = None, unarchived: bool = False, starred: bool | None = None, category: str | None = None, source_id: int | None = None,
    group: str | None = None, least_importance: int | None = None, importance: int | None = None, unclassified: bool = False, summarised: bool = False, like: str | None = None,
    all_copies: bool = False, limit: int | None = 200, offset: int = 0,
) -> DataFrame:
    """Articles with their source's name that meet all given conditions, the newest first. ``limit`` None lists all."""
    out = articles.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"), "group_name"), "source_id", "left")
    conditions = [
        None if status is None else F.col("status") == status,
        F.col("status").isin("unread", "read") if unarchived else None,
        None if starred is None else F.col("starred") == starred,
        None if category is None else F.col("category") == category,
        None if source_id is None else F.col("source_id") == source_id,
        None if group is None else F.col("group_name") == group,
        None if least_importance is None else F.col("importance") >= least_importance,
        None if importance is None else F.col("importance") == importance,
        ~F.col("classified") if unclassified else None,
        F.col("summary") != "" if summarised else None,
        None if like is None else F.ilike(F.col("title"), F.lit(f"%{like}%")) | F.ilike(F.col("author"), F.lit(f"%{like}%")),
        None if all_copies else is_anchor(),
    ]
    for condition in conditions:
        out = out if condition is None else out.where(condition)
    if limit is None:
        return out
    return out.orderBy(*newest_first()).offset(offset).limit(limit if limit > 0 else 200)


def lookup_articles(articles: DataFrame, keys: DataFrame, by: str = "id") -> DataFrame:
    """Articles in the order of ``keys`` (pos, and ids or urls); unknown keys are left out, of one url the first article counts."""
    own = articles if by == "id" else articles.join(articles.groupBy("url").agg(F.min("id").alias("_first")), "url").where("id = _first").drop("_first")
    return keys.join(own, by).orderBy("pos")


def unclassified_queue(articles: DataFrame, as_of: Column, age_days: int = 14, limit: int | None = 100) -> DataFrame:
    own = articles.where((F.col("status") != "archived") & ~F.col("classified") & is_anchor() & since("fetched_at", as_of, age_days) & (F.col("published").isNull() | since("published", as_of, age_days)))
    return own if limit is None else own.orderBy(*newest_first()).limit(limit)


def recent_articles(articles: DataFrame, as_of: Column, days: int = 7, limit: int | None = 500) -> DataFrame:
    """Copies included."""
    own = articles.where((F.col("status") != "archived") & since("fetched_at", as_of, days))
    return own if limit is None else own.orderBy(*newest_first()).limit(limit)


def kb_candidates(articles: DataFrame, noted: DataFrame, as_of: Column, least_importance: int = 2, days: int = 30, limit: int | None = 200) -> DataFrame:
    """Important classified anchors without a note; ``noted`` has article ids as ``id``."""
    own = articles.where(F.col("classified") & (F.col("importance") >= least_importance) & (F.col("status") != "archived") & since("fetched_at", as_of, days) & is_anchor())
    own = own.join(noted.select("id"), "id", "left_anti")
    return own if limit is None else own.orderBy(*newest_first(F.desc("importance"))).limit(limit)


def stale_notes(articles: DataFrame, noted: DataFrame, notes: DataFrame, limit: int | None = None) -> DataFrame:
    """Articles whose note isn't newer; ``noted`` has (id, note_id)."""
    n = notes.select(F.col("id").alias("note_id"), F.col("updated_at").alias("note_updated"))
    own = articles.join(noted, "id").join(n, "note_id").where("updated_at >= note_updated")
    return own if limit is None else own.orderBy(F.desc("updated_at"), "id").limit(limit)


def inbox(articles: DataFrame, noted: DataFrame, limit: int | None = 100) -> DataFrame:
    own = articles.where("status <> 'archived'").join(noted.select("id"), "id", "left_anti")
    return own if limit is None else own.orderBy(*newest_first()).limit(limit)


def pending_extraction(articles: DataFrame, least: int = 200, limit: int | None = 20) -> DataFrame:
    own = articles.where(~F.col("extracted") & (F.length("content_md") < least) & (F.col("url") != "") & is_anchor())
    return own if limit is None else own.orderBy(F.desc("importance"), F.desc("fetched_at"), "id").limit(limit)


def extract_pending(articles: DataFrame, pages: DataFrame, least: int = 200) -> DataFrame:
    """Articles with the body of their landed page where theirs was pending and the page's could be read; ``pages`` has url, markdown, outcome."""
    read = pages.where("outcome = 'extracted'").groupBy("url").agg(F.min("markdown").alias("content_md"))
    found = pending_extraction(articles, least, None).select("id", "url").join(read, "url").select("id", "content_md", F.lit(True).alias("extracted"))
    return apply_changes(articles, found)


def apply_status_changes(articles: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, event rows) after a change table (id, status, actor, at); rows of unknown status or article change nothing and make no event."""
    valid = changes.where(F.col("status").isin(*STATUSES)).join(articles.select("id"), "id", "left_semi")
    events = valid.select(F.col("id").alias("article_id"), F.col("status").alias("event"), "actor", F.col("at").alias("created_at"))
    last = valid.groupBy("id").agg(F.max_by("status", "at").alias("status"))
    return apply_changes(articles, last), events


def replay_events(events: DataFrame) -> DataFrame:
    """(article_id, status, starred) from the event log: the last event of either kind counts; without one, status is null and starred false."""
    at = F.struct("created_at", "id")
    own = events.groupBy("article_id").agg(
        F.max_by("event", F.when(F.col("event").isin(*STATUSES), at)).alias("status"), (F.max_by("event", F.when(F.col("event").isin("starred", "unstarred"), at)).eqNullSafe("starred")).alias("starred")
    )
    return own
