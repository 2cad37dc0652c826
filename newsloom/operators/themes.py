"""Themes: concepts around a seed that occur in the same notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import display_name

from newsloom.operators.graph import concept_pairs
from newsloom.operators.tables import checkpointed

SHARED, LEAST_CONCEPTS, LEAST_NOTES, PARTNERS, THEMES = 2, 2, 3, 5, 12


def cluster_themes(mentions: DataFrame, stored: DataFrame) -> DataFrame:
    """(seed, concepts, notes) of at most ``THEMES`` themes, picked one after the other.

    ``mentions`` (concept_slug, note_id); ``stored`` (slug, pos): seeds to try first. A round judges all unused
    seeds at once and takes the first that holds after the one before; a seed that fails changes nothing, so this
    equals trying them in turn. The driver sees one row a round.
    """
    m = checkpointed(mentions.select("concept_slug", "note_id").distinct())
    pairs = checkpointed(concept_pairs(m).where(F.col("shared") >= SHARED))
    counts = m.groupBy("concept_slug").agg(F.count("*").alias("n"))
    seeds = counts.join(stored.select(F.col("slug").alias("concept_slug"), "pos"), "concept_slug", "left").where(F.col("n") >= LEAST_NOTES - 1)
    seeds = checkpointed(seeds.select("concept_slug", F.struct(F.coalesce("pos", F.lit(2**31 - 1)).alias("p"), (-F.col("n")).alias("m"), F.col("concept_slug").alias("s")).alias("rank")))
    used, themes, last = [], [], None
    for number in range(THEMES):
        free = seeds.where(~F.col("concept_slug").isin(used)) if used else seeds
        free = free if last is None else free.where(F.col("rank") > F.struct(F.lit(last["p"]).alias("p"), F.lit(last["m"]).cast("long").alias("m"), F.lit(last["s"]).alias("s")))
        own = pairs.where(~F.col("b").isin(used)) if used else pairs
        top = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
        partners = own.join(free.select(F.col("concept_slug").alias("a")), "a", "left_semi").withColumn("k", F.row_number().over(top)).where(F.col("k") <= PARTNERS).select("a", "b")
        members = partners.unionByName(partners.select("a", F.col("a").alias("b")).distinct())
        hits = members.join(m, F.col("b") == F.col("concept_slug")).groupBy("a", "note_id").agg(F.collect_set("b").alias("named")).where(F.size("named") >= 2)
        kept = hits.select("a", F.explode("named").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= SHARED)
        concepts = kept.groupBy("a").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "b"))), lambda x: x["b"]).alias("concepts")).where(F.size("concepts") >= LEAST_CONCEPTS)
        notes = hits.groupBy("a").agg(F.count("*").alias("notes")).where(F.col("notes") >= LEAST_NOTES)
        first = free.join(concepts, F.col("concept_slug") == F.col("a")).drop("a").join(notes, F.col("concept_slug") == F.col("a")).orderBy("rank").select("rank", "concepts", "notes", F.lit(number).alias("number")).first()
        if first is None:
            break
        last = first["rank"]
        used += [c for c in first["concepts"] if c not in used] + [last["s"]]
        themes.append((number, last["s"], first["concepts"], first["notes"]))
    return mentions.sparkSession.createDataFrame(themes, "number int, seed string, concepts array<string>, notes long")


def theme_summary(themes: DataFrame, mentions: DataFrame, notes: DataFrame) -> DataFrame:
    """(seed, title, notes, first_day, last_day): the top three concepts and the notes that name two or more members."""
    members = themes.select("seed", F.explode("concepts").alias("concept_slug"))
    hits = members.join(mentions.select("concept_slug", "note_id").distinct(), "concept_slug").groupBy("seed", "note_id").count().where("count >= 2")
    dated = hits.join(notes.select(F.col("id").alias("note_id"), F.to_date("created_at").alias("day")), "note_id").groupBy("seed").agg(F.count("*").alias("notes"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return themes.select("seed", F.array_join(F.slice("concepts", 1, 3), " · ").alias("title")).join(dated, "seed")


def theme_views(themes: DataFrame, mentions: DataFrame, notes: DataFrame, most: int = 20) -> DataFrame:
    """(slug, title, created, summary, concepts, notes) of themes, for their documents: the ``most`` newest notes in order of days, and each concept's notes here and in all."""
    members = themes.select("seed", F.posexplode("concepts").alias("pos", "concept_slug"))
    facts = mentions.select("concept_slug", "note_id").distinct()
    named = members.join(facts, "concept_slug")
    hits = named.groupBy("seed", "note_id").agg(F.count("*").alias("_c")).where("_c >= 2").drop("_c")
    newest = Window.partitionBy("seed").orderBy(F.desc("created_at"), F.desc("note_id"))
    listed = hits.join(notes.select(F.col("id").alias("note_id"), F.col("slug").alias("note_slug"), "title", "created_at"), "note_id").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= most)
    day = F.date_format("created_at", "yyyy-MM-dd")
    told = listed.groupBy("seed").agg(F.min("created_at").alias("created"), F.array_sort(F.collect_list(F.struct(day.alias("day"), F.col("note_id").alias("id"), F.col("note_slug").alias("slug"), "title"))).alias("notes"))
    here = named.join(hits, ["seed", "note_id"], "left_semi").groupBy("seed", "pos", "concept_slug").agg(F.count("*").alias("here"))
    total = facts.groupBy("concept_slug").agg(F.count("*").alias("total"))
    held = here.join(total, "concept_slug").groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("concept_slug").alias("slug"), display_name(F.col("concept_slug")).alias("name"), F.col("here").alias("notes"), "total"))).alias("concepts"))
    title = themes.select("seed", F.array_join(F.slice("concepts", 1, 3), " · ").alias("title"))
    return title.join(told, "seed").join(held, "seed").select(F.col("seed").alias("slug"), "title", "created", F.lit(None).cast("string").alias("summary"), "concepts", "notes")
