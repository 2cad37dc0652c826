"""From classified articles to notes: atoms, electrons, refreshes, and the whole build in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import content_key, slugify, tag_slugs
from newsloom.operators import graph as G
from newsloom.operators.tables import upsert

#: Notes that a concept's note lists.
SOURCES = 500


def build_atoms(candidates: DataFrame, aliases: DataFrame, concepts: DataFrame, owners: DataFrame) -> DataFrame:
    """Note rows (id, note_type, slug, title, category, tags, wikilinks, created_at) of candidate articles; links are resolved concepts, sorted, each once."""
    named = G.allocate_note_slugs(candidates.select("id", slugify(F.col("title")).alias("slug")), owners)
    slugs = candidates.select("id", F.explode(tag_slugs(F.col("tags"))).alias("slug")).distinct()
    resolved = slugs.join(G.resolve_concepts(slugs, aliases, concepts), "slug").groupBy("id").agg(F.array_sort(F.collect_set("concept")).alias("wikilinks"))
    out = candidates.join(named, "id").join(resolved, "id", "left")
    tags = F.array_distinct(F.concat(F.array(F.lit("atom"), F.lit("ai")), "tags"))
    return out.select("id", F.lit("atom").alias("note_type"), F.col("note_slug").alias("slug"), "title", "category", tags.alias("tags"), F.coalesce("wikilinks", F.array().cast("array<string>")).alias("wikilinks"), F.col("fetched_at").alias("created_at"))


def electron_view(concepts: DataFrame, mentions: DataFrame, notes: DataFrame) -> DataFrame:
    """(slug, sources, related, months, definition_key): what a concept's note shows, of its notes the newest ``SOURCES``; the key changes with its name or those notes."""
    newest = Window.partitionBy("concept_slug").orderBy(F.desc("_made"), F.desc("note_id"))
    named = mentions.select("concept_slug", "note_id").distinct().join(notes.select(F.col("id").alias("note_id"), F.col("slug").alias("source"), F.col("created_at").alias("_made")), "note_id")
    sources = named.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= SOURCES).groupBy(F.col("concept_slug").alias("slug")).agg(F.array_sort(F.collect_set("source")).alias("sources"))
    related = G.co_occurring(mentions).groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("shared")).alias("n"), "related"))), lambda x: x["related"]).alias("related"))
    months = G.mentions_by_month(mentions).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("months"))
    return concepts.select("slug").join(sources, "slug").join(related, "slug", "left").join(months, "slug", "left").withColumn("definition_key", content_key(F.col("slug"), F.col("sources")))


def define_concepts(views: DataFrame, stored: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """(slug, definition, definition_key): stored definitions (slug, definition, definition_key) while their key holds; only the others reach ``fn`` (slug, definition)."""
    keyed = views.select("slug", "definition_key")
    held = keyed.join(stored, ["slug", "definition_key"])
    new = keyed.join(stored.select("slug", "definition_key"), ["slug", "definition_key"], "left_anti")
    written = new.select("slug").mapInPandas(fn, "slug string, definition string")
    return held.select("slug", "definition", "definition_key").unionByName(new.join(written, "slug").select("slug", "definition", "definition_key"))


def refresh_atoms(rendered: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, outcome) of rendered (id, document) against stored documents: rewritten where the text differs, else fresh."""
    old = stored.select("id", F.sha2("document", 256).alias("_old"))
    return rendered.join(old, "id").select("id", F.when(F.sha2("document", 256).eqNullSafe(F.col("_old")), "fresh").otherwise("rewritten").alias("outcome"))


def save_themes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Themes by slug: the first created_at stays, a note id is kept where no new one comes."""
    both = upsert(stored, new, ["slug"], keep=("created_at",)).drop("created")
    return both.join(stored.select("slug", F.col("note_id").alias("_old")), "slug", "left").withColumn("note_id", F.coalesce("note_id", "_old")).drop("_old")


def kb_build(candidates: DataFrame, notes: DataFrame, mentions: DataFrame, concepts: DataFrame, aliases: DataFrame, promote_at: int = 2) -> dict[str, DataFrame]:
    """The build in order: atoms, mentions and counts, promotions. Nothing is read again from storage between the steps."""
    atoms = build_atoms(candidates, aliases, concepts, notes.select("slug"))
    new = atoms.select(F.explode("wikilinks").alias("concept_slug"), F.col("id").alias("note_id"), "created_at")
    facts, counted = G.record_mentions(mentions, new)
    known = counted.join(concepts.select("slug", "note_id"), "slug", "left")
    return {"atoms": atoms, "mentions": facts, "concepts": known, "promoted": G.promote_concepts(known, notes.where("note_type <> 'electron'").select("slug"), promote_at)}
