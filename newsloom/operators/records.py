"""Changes to kept tables by change tables: sources, rules, stars, digests and the ledger of ingests. Each returns new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def change_records(table: DataFrame, changes: DataFrame, as_of: Column) -> DataFrame:
    """``table`` (id, enabled, updated_at and other columns) after ``changes`` (id, op and some of its columns), one a record.

    ``create`` adds a record, numbered on after the largest id in the order of the changes' ids; ``update`` puts in the
    values that aren't null; ``enable``, ``disable`` and ``hide`` set a flag; ``delete`` takes the record out.
    Changes of a record that isn't there do nothing. What changes gets ``as_of`` as its updated_at.
    """
    own = [c for c in changes.columns if c not in ("id", "op")]
    new = changes.where("op <> 'create'").select("id", "op", *[F.col(c).alias(f"_new_{c}") for c in own])
    both = table.join(new, "id", "left").where("op IS NULL OR op <> 'delete'")
    values = {c: F.when(F.col("op") == "update", F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)) if c in own else F.col(c) for c in table.columns}
    values["enabled"] = F.when(F.col("op").isin("enable", "disable"), F.col("op") == "enable").otherwise(values["enabled"])
    if "hidden" in table.columns:
        values["hidden"] = F.when(F.col("op") == "hide", True).otherwise(values["hidden"])
    values["updated_at"] = F.when(F.col("op").isNotNull(), as_of).otherwise(F.col("updated_at"))
    kept = both.select(*[values[c].alias(c) for c in table.columns])
    last = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"), F.lit("create").alias("op"))
    # records are entered by people, so that the new ones of a change table are few
    number = F.row_number().over(Window.partitionBy("op").orderBy("id"))
    made = changes.where("op = 'create'").withColumn("_n", number).join(last, "op")
    fresh = {c: F.col(c).cast(table.schema[c].dataType) if c in own else F.lit(None).cast(table.schema[c].dataType) for c in table.columns}
    fresh |= {"id": (F.col("_last") + F.col("_n")).cast(table.schema["id"].dataType), "updated_at": as_of}
    return kept.unionByName(made.select(*[fresh[c].alias(c) for c in table.columns]))


def orphaned_articles(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Articles whose source is gone; they are kept."""
    return articles.join(sources.select(F.col("id").alias("source_id")), "source_id", "left_anti").select(*articles.columns)


def change_stars(articles: DataFrame, changes: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(articles, events): ``starred`` after ``changes`` (id, starred), and an event of the user's for each change of an article that there is."""
    new = changes.select("id", F.col("starred").alias("_starred"))
    out = articles.join(new, "id", "left").withColumn("starred", F.coalesce("_starred", "starred")).select(*articles.columns)
    event = F.when(F.col("_starred"), "starred").otherwise("unstarred")
    events = new.join(articles.select("id"), "id", "left_semi").select(F.col("id").alias("article_id"), event.alias("event"), F.lit("user").alias("actor"), as_of.alias("created_at"))
    return out, events


def save_digest(stored: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """Digests (date, overview, themes, created_at): ``new`` ones (date, overview, themes) take the place of those of their day."""
    dated = new.select("date", "overview", "themes", as_of.alias("created_at"))
    return stored.join(dated.select("date"), "date", "left_anti").select(*dated.columns).unionByName(dated)


def record_ingests(ledger: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """The ledger (ref_type, ref_id, note_id, status, created_at) with ``new`` rows (ref_type, ref_id, note_id, status).

    A known reference gets the new note and status and keeps its time; an empty status is ``processed``.
    """
    key = ["ref_type", "ref_id"]
    own = new.select(*key, "note_id", F.coalesce(F.nullif("status", F.lit("")), F.lit("processed")).alias("status"))
    first = ledger.select(*key, F.col("created_at").alias("_first"))
    written = own.join(first, key, "left").select(*key, "note_id", "status", F.coalesce("_first", as_of).alias("created_at"))
    return ledger.join(own.select(*key), key, "left_anti").select(*written.columns).unionByName(written)


def known_ingests(references: DataFrame, ledger: DataFrame) -> DataFrame:
    """(ref_type, ref_id, known, note_id) of references: whether the ledger has them, and their note (0 without)."""
    held = ledger.select("ref_type", "ref_id", "note_id", F.lit(True).alias("_known"))
    return references.join(held, ["ref_type", "ref_id"], "left").select("ref_type", "ref_id", F.coalesce("_known", F.lit(False)).alias("known"), F.coalesce("note_id", F.lit(0)).alias("note_id"))
