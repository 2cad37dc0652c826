"""The knowledge base built and kept up to date: each step takes what changed, by key or by the hash of what is written.

A ``Vault`` is a set of tables. ``build`` returns the vault after a run and counts of what the run did; a run over a vault
in which nothing has changed writes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import canon_key, concept_name, concept_slugs, display_name, note_day, slugify, strip_brackets
from newsloom.operators import documents as D
from newsloom.operators import graph as G
from newsloom.operators.articles import kb_candidates
from newsloom.operators.records import record_ingests
from newsloom.operators.tables import numbered, stored
from newsloom.operators.themes import cluster_themes, theme_views

#: Notes that a concept's document lists, the newest first, and others that it comes up with.
SOURCES, RELATED = 500, 8
PROMOTE_AT, THEME_DAYS = 2, 90
_MENTION = "concept_slug string, note_id long, created_at timestamp_ntz, name string"
_WRITTEN = "slug string, id long, outcome string"
_NOTE = ["id", "note_type", "slug", "title", "category", "tags", "wikilinks", "frontmatter", "content", "content_hash", "created_at", "updated_at"]


@dataclass(frozen=True)
class Vault:
    """``notes`` (columns of ``_NOTE``; note_type atom, electron, molecule or the reader's own), ``mentions`` (concept_slug, note_id, created_at),
    ``concepts`` (slug, name, note_id, mentions, first_seen, last_seen), ``aliases`` (alias, canonical), ``ledger`` (ref_type, ref_id, note_id, status, created_at)."""

    notes: DataFrame
    mentions: DataFrame
    concepts: DataFrame
    aliases: DataFrame
    ledger: DataFrame


def _nothing(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


def _text_array(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def write_notes(notes: DataFrame, rendered: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(notes, written) after ``rendered`` (slug, note_type, title, category, tags, wikilinks, frontmatter, content).

    A note of the same slug and type is rewritten if its content, title, tags or links differ; without one it is created and numbered on; a slug that a
    note of another type owns is left to it. ``written``: (slug, id, outcome: created, updated or fresh).
    """
    own = notes.select("slug", F.col("id").alias("_id"), F.col("note_type").alias("_type"), F.col("created_at").alias("_created"), F.sha2(F.to_json(F.struct("content", "title", "tags", "wikilinks")), 256).alias("_hash"))
    new = rendered.withColumn("_new", F.sha2(F.to_json(F.struct("content", "title", "tags", "wikilinks")), 256))
    both = new.join(own, "slug", "left").where("_type IS NULL OR _type = note_type")
    judged = stored(both.withColumn("outcome", F.when(F.col("_id").isNull(), "created").when(F.col("_new") == F.col("_hash"), "fresh").otherwise("updated")))
    outcomes = {r["outcome"] for r in judged.select("outcome").distinct().collect()}
    changed = judged.where("outcome <> 'created'").withColumn("id", F.col("_id"))
    if outcomes <= {"fresh"}:
        return notes, changed.select("slug", "id", "outcome")
    if "created" in outcomes:
        last = notes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        changed = changed.unionByName(numbered(judged.where("outcome = 'created'"), "id", last, "slug"))
    rows = changed.where("outcome <> 'fresh'").withColumns({"created_at": F.coalesce("_created", as_of), "updated_at": as_of, "content_hash": F.sha2(F.col("content").cast("binary"), 256)}).select(*_NOTE)
    after = stored(notes.join(rows.select("id"), "id", "left_anti").select(*_NOTE).unionByName(rows))
    return after, stored(changed.select("slug", "id", "outcome"))


def import_notes(vault: Vault, own: DataFrame, as_of: Column) -> tuple[Vault, DataFrame]:
    """The reader's own notes (slug, title, content, tags, wikilinks) joined to the vault, and what became of each."""
    rendered = own.select("slug", F.lit("user").alias("note_type"), "title", F.lit("").alias("category"), "tags", "wikilinks", F.lit("{}").alias("frontmatter"), "content")
    notes, written = write_notes(vault.notes, rendered, as_of)
    return replace(vault, notes=notes), written


def batch_concepts(candidates: DataFrame, vault: Vault) -> DataFrame:
    """(id, raw, concept, name) of the concepts that articles (id, tags, entities) name: ``concept`` is the slug of its note.

    Aliases and stored spellings come first; of spellings that meet in the batch the first article's counts, and so does its name.
    Notes' names are given out so that no concept takes another's, nor that of a note of another kind.
    """
    raw = candidates.select("id", "entities", "tags", F.explode(concept_slugs(F.col("entities"), F.col("tags"))).alias("raw"))
    raw = stored(raw.select("id", "raw", concept_name(F.col("entities"), F.col("tags"), F.col("raw")).alias("_name")).where("raw <> ''"))
    known = vault.concepts.withColumn("canon_key", canon_key(F.col("slug")))
    resolved = G.resolve_concepts(raw.select(F.col("raw").alias("slug")), vault.aliases, known).withColumnRenamed("slug", "raw")
    own = stored(raw.join(resolved, "raw"))
    folded = G.fold_spellings(own.select("id", F.col("concept").alias("slug"))).select(F.col("slug").alias("concept"), F.col("concept").alias("_key"))
    keyed = own.join(folded, "concept")
    others = vault.notes.where("note_type <> 'electron'").select("slug")
    named = G.allocate_concept_slugs(keyed.select(F.col("_key").alias("slug")).distinct(), others)
    first = keyed.groupBy("_key").agg(F.min_by("_name", F.struct("id", "raw")).alias("name"))
    return stored(keyed.join(named, F.col("_key") == F.col("slug")).drop("slug").join(first, "_key").select("id", "raw", F.col("note_slug").alias("concept"), "name"))


def _atoms(articles: DataFrame, named: DataFrame) -> DataFrame:
    """Rendered atoms (with id, the article's) of articles with ``slug``, linking to the concepts of ``named`` (id, concept)."""
    links = named.groupBy("id").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    own = articles.join(links, "id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    if "coverage" not in own.columns:
        own = own.withColumn("coverage", F.array().cast("array<struct<name:string,url:string>>"))
    head = F.to_json(F.struct("category", F.col("importance").alias("rating"), F.col("source_name").alias("source"), "tags", F.lit("atom").alias("type"), "url"))
    columns = ["id", "slug", F.lit("atom").alias("note_type"), "title", "category", F.concat(_text_array("atom", "ai"), "tags").alias("tags"), F.col("concepts").alias("wikilinks"), head.alias("frontmatter")]
    return own.select(*columns).join(D.render_atoms(own).withColumnRenamed("document", "content"), "id")


def add_atoms(vault: Vault, candidates: DataFrame, as_of: Column) -> tuple[Vault, DataFrame, DataFrame]:
    """(vault, concepts of the batch, written): one atom for each candidate article, its row in the ledger, and its mentions."""
    if candidates.isEmpty():
        return vault, _nothing(candidates, _MENTION), _nothing(candidates, _WRITTEN)
    named = batch_concepts(candidates, vault)
    taken = vault.notes.select("slug").unionByName(named.select(F.col("concept").alias("slug")).distinct())
    slugs = G.allocate_note_slugs(candidates.select("id", slugify(strip_brackets(F.col("title"))).alias("slug")), taken).withColumnRenamed("note_slug", "slug")
    rendered = stored(_atoms(candidates.join(slugs, "id"), named))
    notes, written = write_notes(vault.notes, rendered.drop("id"), as_of)
    noted = stored(rendered.select(F.col("id").alias("article"), "slug").join(written, "slug"))
    ledger = record_ingests(vault.ledger, noted.select(F.lit("article").alias("ref_type"), F.col("article").cast("string").alias("ref_id"), F.col("id").alias("note_id"), F.lit("processed").alias("status")), as_of)
    new = named.join(noted.select(F.col("article").alias("id"), F.col("id").alias("note_id")), "id").select(F.col("concept").alias("concept_slug"), "note_id", as_of.alias("created_at"), "name")
    return replace(vault, notes=notes, ledger=stored(ledger)), stored(new), written


def record_mentions(vault: Vault, new: DataFrame) -> Vault:
    """The vault with new mentions (concept_slug, note_id, created_at, name): facts count once; a concept that is named takes the name."""
    facts, counted = G.record_mentions(vault.mentions, new.select("concept_slug", "note_id", "created_at"))
    names = new.where("name IS NOT NULL").groupBy(F.col("concept_slug").alias("slug")).agg(F.min("name").alias("_name"))
    held = vault.concepts.select("slug", "note_id", F.col("name").alias("_old"), F.col("mentions").alias("_m"), F.col("first_seen").alias("_f"), F.col("last_seen").alias("_l"))
    both = counted.join(held, "slug", "full_outer").join(names, "slug", "left")
    concepts = both.select("slug", F.coalesce("_name", "_old", "slug").alias("name"), "note_id", F.coalesce("mentions", "_m").alias("mentions"), F.coalesce("first_seen", "_f").alias("first_seen"), F.coalesce("last_seen", "_l").alias("last_seen"))
    return replace(vault, mentions=stored(facts), concepts=stored(concepts))


def electron_views(vault: Vault, wanted: DataFrame, as_of: Column) -> DataFrame:
    """(slug, name, created, definition, sources, related, months) of the concepts in ``wanted`` (slug), for their documents; at most ``SOURCES`` notes of each."""
    facts = vault.mentions.join(wanted.select(F.col("slug").alias("concept_slug")), "concept_slug", "left_semi")
    newest = Window.partitionBy("concept_slug").orderBy(F.desc("note_created"), F.desc("note_id"))
    told = facts.join(vault.notes.select(F.col("id").alias("note_id"), F.col("slug").alias("note_slug"), "title", F.col("created_at").alias("note_created")), "note_id").withColumn("n", F.row_number().over(newest)).where(F.col("n") <= SOURCES)
    sources = told.groupBy(F.col("concept_slug").alias("slug")).agg(F.array_sort(F.collect_list(F.struct("n", F.col("note_slug").alias("slug"), "title"))).alias("sources"))
    months = G.mentions_by_month(facts).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("months"))
    # pairs of wanted concepts only
    other = vault.mentions.select(F.col("concept_slug").alias("related"), "note_id")
    shared = facts.join(other, "note_id").where("concept_slug <> related").groupBy(F.col("concept_slug").alias("slug"), "related").agg(F.count("*").alias("shared"))
    top = Window.partitionBy("slug").orderBy(F.desc("shared"), "related")
    best = shared.withColumn("n", F.row_number().over(top)).where(F.col("n") <= RELATED).join(vault.concepts.select(F.col("slug").alias("related"), "name"), "related", "left")
    related = best.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("n", F.col("related").alias("slug"), F.coalesce("name", "related").alias("name"), "shared"))).alias("related"))
    created = vault.notes.where("note_type = 'electron'").select("slug", F.col("created_at").alias("created"))
    none = F.array().cast(related.schema["related"].dataType)
    own = vault.concepts.join(wanted.select("slug"), "slug", "left_semi").select("slug", "name")
    out = own.join(sources, "slug").join(months, "slug").join(related, "slug", "left").join(created, "slug", "left")
    return out.withColumns({"created": F.coalesce("created", as_of), "definition": F.lit(None).cast("string"), "related": F.coalesce("related", none)})


def write_electrons(vault: Vault, wanted: DataFrame, as_of: Column) -> tuple[Vault, DataFrame]:
    """Notes of the concepts in ``wanted`` (slug), and what became of each; a concept whose slug another note owns stays without."""
    if wanted.isEmpty():
        return vault, _nothing(wanted, _WRITTEN)
    views = stored(electron_views(vault, wanted, as_of))
    head = F.to_json(F.struct("name", _text_array("ai", "concept").alias("tags"), F.lit("electron").alias("type")))
    rows = views.select("slug", F.lit("electron").alias("note_type"), F.col("name").alias("title"), F.lit("").alias("category"), _text_array("ai", "concept").alias("tags"), F.transform("sources", lambda s: s["slug"]).alias("wikilinks"), head.alias("frontmatter"))
    rendered = rows.join(D.render_electrons(views, F.col("created")).withColumnRenamed("document", "content"), "slug")
    notes, written = write_notes(vault.notes, rendered, as_of)
    concepts = vault.concepts.join(written.select("slug", F.col("id").alias("_note")), "slug", "left").withColumn("note_id", F.coalesce("note_id", "_note")).drop("_note")
    return replace(vault, notes=notes, concepts=stored(concepts)), written


def due_concepts(vault: Vault, touched: DataFrame, promote_at: int = PROMOTE_AT, explicit: DataFrame | None = None) -> DataFrame:
    """(slug) of concepts whose note is to be written: those with one that ``touched`` (slug) names, those mentioned ``promote_at`` times that have none, and ``explicit`` ones."""
    held = vault.concepts.where("note_id IS NOT NULL").select("slug").join(touched.select("slug").distinct(), "slug", "left_semi")
    queued = vault.concepts.where(F.col("note_id").isNull() & (F.col("mentions") >= promote_at)).select("slug")
    asked = vault.concepts.join(explicit.select("slug"), "slug", "left_semi").select("slug") if explicit is not None else queued.limit(0)
    return stored(held.unionByName(queued).unionByName(asked).distinct())


def refresh_atoms(vault: Vault, articles: DataFrame, as_of: Column) -> tuple[Vault, DataFrame]:
    """Atoms whose article changed after they were written (updated_at) are rendered again; those that come out as they were are marked fresh."""
    held = vault.ledger.where("ref_type = 'article'").select(F.col("ref_id").cast("long").alias("id"), "note_id")
    old = vault.notes.where("note_type = 'atom'").select(F.col("id").alias("note_id"), "slug", F.col("updated_at").alias("_written"))
    stale = stored(articles.join(held, "id").join(old, "note_id").where("updated_at > _written").drop("note_id", "_written"))
    if stale.isEmpty():
        return vault, _nothing(stale, _WRITTEN)
    named = batch_concepts(stale, vault)
    notes, written = write_notes(vault.notes, _atoms(stale, named).drop("id"), as_of)
    fresh = written.where("outcome = 'fresh'").select("id", F.lit(True).alias("_fresh"))
    notes = notes.join(fresh, "id", "left").withColumn("updated_at", F.when(F.col("_fresh"), as_of).otherwise(F.col("updated_at"))).select(*_NOTE)
    return replace(vault, notes=stored(notes)), written


def repair_names(vault: Vault) -> tuple[Vault, DataFrame]:
    """Concepts whose name is still their slug get a readable one; (slug) of those that changed."""
    better = stored(vault.concepts.where((F.col("name") == F.col("slug")) & (display_name(F.col("slug")) != F.col("slug"))).select("slug", display_name(F.col("slug")).alias("_name")))
    concepts = vault.concepts.join(better, "slug", "left").withColumn("name", F.coalesce("_name", "name")).drop("_name")
    return replace(vault, concepts=vault.concepts if better.isEmpty() else stored(concepts)), better.select("slug")


def write_themes(vault: Vault, as_of: Column, days: int = THEME_DAYS) -> tuple[Vault, DataFrame]:
    """A molecule for each theme of the notes of the last ``days``; a theme keeps its note while its seed does, and molecules known are tried first."""
    recent = stored(G.mentions_since(vault.mentions, vault.notes, as_of, days))
    known = vault.notes.where("note_type = 'molecule' AND startswith(slug, 'theme-')").orderBy("id").limit(1000).select(F.expr("substring(slug, 7)").alias("slug"), F.row_number().over(Window.orderBy("id")).alias("pos"))
    themes = cluster_themes(recent, known)
    created = vault.notes.where("note_type = 'molecule'").select(F.expr("substring(slug, 7)").alias("slug"), F.col("created_at").alias("_created"))
    views = theme_views(themes, recent, vault.notes).join(created, "slug", "left").withColumn("created", F.coalesce("_created", as_of)).drop("_created")
    return _write_molecules(vault, stored(views).withColumn("slug", F.concat(F.lit("theme-"), "slug")), as_of)


def _write_molecules(vault: Vault, views: DataFrame, as_of: Column) -> tuple[Vault, DataFrame]:
    head = F.to_json(F.struct(_text_array("synthesis", "ai", "theme").alias("tags"), F.lit("molecule").alias("type")))
    rows = views.select("slug", F.lit("molecule").alias("note_type"), "title", F.lit("").alias("category"), _text_array("synthesis", "ai", "theme").alias("tags"), F.concat(F.transform("concepts", lambda c: c["slug"]), F.transform("notes", lambda n: n["slug"])).alias("wikilinks"), head.alias("frontmatter"))
    rendered = rows.join(D.render_molecules(views).withColumnRenamed("document", "content"), "slug")
    notes, written = write_notes(vault.notes, rendered, as_of)
    return replace(vault, notes=notes), written


def cited_concepts(vault: Vault, as_of: Column) -> DataFrame:
    """New mentions (concept_slug, note_id, created_at, name) that the reader's notes make of concepts that there are."""
    known = vault.concepts.withColumn("canon_key", canon_key(F.col("slug")))
    cited = G.user_note_mentions(vault.notes.where("note_type = 'user'"), known, vault.aliases).join(vault.mentions, ["concept_slug", "note_id"], "left_anti")
    return stored(cited.select("concept_slug", "note_id", as_of.alias("created_at"), F.lit(None).cast("string").alias("name")))


def synthesize(vault: Vault, categories: DataFrame, as_of: Column, *, newest: int = 100, listed: int = 20, top: int = 6) -> tuple[Vault, DataFrame]:
    """A molecule for each of ``categories`` (category): the dated story of its atoms, and the concepts that they name most.

    Of a category the ``newest`` atoms are looked at; the ``listed`` latest of them by the day they are about, then id, are told in order. Concepts count
    once a note, links that are no concepts don't. A category without atoms gives nothing; a slug that another note owns stays with it.
    """
    at = Window.partitionBy("category").orderBy(F.desc("created_at"), F.desc("id"))
    atoms = vault.notes.where("note_type = 'atom'").join(categories.select("category").distinct(), "category", "left_semi")
    atoms = stored(atoms.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= newest).select("category", "id", "slug", "title", "wikilinks", note_day(F.col("content"), F.col("created_at")).alias("day")))
    latest = Window.partitionBy("category").orderBy(F.desc("day"), F.desc("id"))
    told = atoms.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= listed)
    notes = told.groupBy("category").agg(F.array_sort(F.collect_list(F.struct(D.note_day(F.col("day")).alias("day"), "id", "slug", "title"))).alias("notes"))
    links = atoms.select("category", "id", F.explode(F.array_distinct("wikilinks")).alias("slug"))
    known = vault.concepts.withColumn("canon_key", canon_key(F.col("slug")))
    named = links.join(G.resolve_concepts(links.select("slug"), vault.aliases, known), "slug").select("category", "id", "concept").distinct()
    counted = named.join(vault.concepts.select(F.col("slug").alias("concept"), "name", F.col("mentions").alias("total")), "concept").groupBy("category", "concept", "name", "total").agg(F.count("*").alias("here"))
    best = Window.partitionBy("category").orderBy(F.desc("here"), "concept")
    ranked = counted.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= top)
    concepts = ranked.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("concept").alias("slug"), "name", F.col("here").alias("notes"), "total"))).alias("concepts"))
    slug = F.concat(F.lit("sintesis-"), slugify(F.col("category")))
    made = vault.notes.where("note_type = 'molecule'").select("slug", F.col("created_at").alias("_created"))
    views = notes.join(concepts, "category", "left").select(slug.alias("slug"), F.concat(F.lit("Síntesis de "), "category").alias("title"), F.lit(None).cast("string").alias("summary"), "notes", F.coalesce("concepts", F.array().cast(concepts.schema["concepts"].dataType)).alias("concepts"))
    views = stored(views.join(made, "slug", "left").withColumn("created", F.coalesce("_created", as_of)).drop("_created"))
    return _write_molecules(vault, views, as_of)


def preview(vault: Vault, articles: DataFrame, own: DataFrame, as_of: Column, *, least_importance: int = 2, days: int = 30, limit: int | None = 200, promote_at: int = PROMOTE_AT) -> dict[str, DataFrame]:
    """What a run of ``build`` would do to ``vault``, which stays as it is: atoms (slug, title, category, concepts), concepts without a note (slug,
    name, mentions, after, promoting), themes (slug, new), and counts (what, n) of stale atoms and of the reader's new and edited notes."""
    after, imported = import_notes(vault, own, as_of)
    noted = vault.ledger.where("ref_type = 'article'").select(F.col("ref_id").cast("long").alias("id"))
    candidates = stored(kb_candidates(articles, noted, as_of, least_importance, days, limit))
    after, new, written = add_atoms(after, candidates, as_of)
    after, stale = refresh_atoms(after, articles, as_of)
    after = record_mentions(after, new)
    after = record_mentions(after, cited_concepts(after, as_of))
    before = vault.concepts.select("slug", F.col("mentions").alias("_m"))
    concepts = after.concepts.where("note_id IS NULL").join(before, "slug", "left").select("slug", "name", F.coalesce("_m", F.lit(0)).alias("mentions"), F.col("mentions").alias("after"), (F.col("mentions") >= promote_at).alias("promoting"))
    _, themes = write_themes(after, as_of)
    atoms = after.notes.join(written.select("slug"), "slug", "left_semi").select("slug", "title", "category", F.col("wikilinks").alias("concepts"))
    n = lambda rows, outcome, name: rows.agg(F.lit(name).alias("what"), F.count_if(F.col("outcome") == outcome).alias("n"))
    counts = n(stale, "updated", "stale_atoms").unionByName(n(imported, "created", "notes_new")).unionByName(n(imported, "updated", "notes_edited"))
    return {"atoms": atoms, "concepts": concepts, "themes": themes.select("slug", (F.col("outcome") == "created").alias("new")), "counts": counts}


def build(vault: Vault, articles: DataFrame, own: DataFrame, as_of: Column, *, least_importance: int = 2, days: int = 30, limit: int | None = 200, promote_at: int = PROMOTE_AT) -> tuple[Vault, DataFrame]:
    """(vault, counts) after a run over articles (with story_id, source_name, entities, updated_at and, if it is known, ``coverage``) and the reader's own notes.

    In order: own notes, atoms of new candidates, mentions, mentions of the reader's notes, stale atoms, names, concepts' notes and promotions,
    themes. A concept's note is written once, after all that it shows has settled.
    """
    vault, imported = import_notes(vault, own, as_of)
    noted = vault.ledger.where("ref_type = 'article'").select(F.col("ref_id").cast("long").alias("id"))
    candidates = stored(kb_candidates(articles, noted, as_of, least_importance, days, limit))
    vault, new, atoms = add_atoms(vault, candidates, as_of)
    vault, refreshed = refresh_atoms(vault, articles, as_of)
    vault = record_mentions(vault, new)
    cited = cited_concepts(vault, as_of)
    vault = vault if cited.isEmpty() else record_mentions(vault, cited)
    vault, renamed = repair_names(vault)
    touched = new.select(F.col("concept_slug").alias("slug")).unionByName(cited.select(F.col("concept_slug").alias("slug"))).unionByName(renamed)
    # whose sources or related concepts may read otherwise now
    moved = refreshed.where("outcome = 'updated'").select(F.col("id").alias("note_id")).join(vault.mentions, "note_id").select(F.col("concept_slug").alias("slug"))
    vault, electrons = write_electrons(vault, due_concepts(vault, touched.unionByName(moved), promote_at), as_of)
    vault, themes = write_themes(vault, as_of)
    kinds = [("notes_imported", imported.where("outcome <> 'fresh'")), ("atoms_created", atoms), ("concepts_tracked", new.select("concept_slug").distinct()), ("atoms_refreshed", refreshed.where("outcome = 'updated'"))]
    kinds += [(f"{name}_{outcome}", rows.where(F.col("outcome") == outcome)) for name, rows in (("electrons", electrons), ("molecules", themes)) for outcome in ("created", "updated")]
    counts = [rows.agg(F.lit(name).alias("what"), F.count("*").alias("n")) for name, rows in kinds]
    every = counts[0]
    for some in counts[1:]:
        every = every.unionByName(some)
    return vault, every


def _head(kind: str, as_of: Column) -> Column:
    return D.frontmatter([("type", F.lit(kind)), ("created", D.note_time(as_of)), ("status", F.lit("generated"))], _text_array("ai", kind))


def index_document(vault: Vault, as_of: Column, top: int = 40, dangling: int = 100, per_category: int = 10, themes: int = 50) -> DataFrame:
    """(document): the entry to the vault: how much there is, what is mentioned most, themes, and the newest atoms of each category."""
    line = lambda slug, title: F.concat(F.lit("- [["), slug, F.lit("]] — "), title)
    one = lambda df, *aggs: df.agg(*aggs).withColumn("_one", F.lit(1))
    kinds = one(vault.notes, *[F.count_if(F.col("note_type") == k).alias(k) for k in ("atom", "electron", "molecule")])
    waiting = one(G.dangling_concepts(vault.concepts).limit(dangling), F.count("*").alias("waiting"))
    most = G.top_concepts(vault.concepts, top).select("mentions", "slug", F.concat(line(F.col("slug"), F.col("name")), F.lit(" · "), F.col("mentions"), F.lit(" mention(s)"), F.when(F.col("note_id").isNull(), " *(no note yet)*").otherwise("")).alias("line"))
    listed = one(most, F.transform(F.array_sort(F.collect_list(F.struct((-F.col("mentions")).alias("m"), "slug", "line"))), lambda x: x["line"]).alias("top"))
    newest = vault.notes.where("note_type = 'molecule'").orderBy(F.desc("created_at"), "id").limit(themes)
    told = one(newest, F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "id", line(F.col("slug"), F.col("title")).alias("line")))), lambda x: x["line"]).alias("themes"))
    placed = G.newest_by_category(vault.notes.where("category <> ''"), per_category).join(vault.notes.select("id", "slug", "title"), "id")
    groups = placed.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", line(F.col("slug"), F.col("title")).alias("line")))), lambda x: x["line"]).alias("lines"))
    by_category = one(groups, F.array_sort(F.collect_list(F.concat(F.lit("\n### "), "category", F.lit("\n"), F.array_join("lines", "\n"), F.lit("\n")))).alias("categories"))
    both = kinds.join(waiting, "_one").join(listed, "_one").join(told, "_one").join(by_category, "_one")
    part = lambda heading, lines, between: F.when(F.size(lines) > 0, F.concat(F.lit(f"## {heading}\n"), F.array_join(lines, between), F.lit("\n" if between else ""), F.lit("\n"))).otherwise("")
    counts = F.concat_ws("", F.col("atom"), F.lit(" atoms · "), F.col("electron"), F.lit(" electrons · "), F.col("molecule"), F.lit(" molecules · "), F.col("waiting"), F.lit(" concepts waiting for one\n\n"))
    document = F.concat(_head("index", as_of), F.lit("\n# AI knowledge index\n\n"), counts, part("Most mentioned", F.col("top"), "\n"), part("Themes", F.col("themes"), "\n"), part("By category", F.col("categories"), ""))
    return both.select(document.alias("document"))


def dangling_document(concepts: DataFrame, as_of: Column, promote_at: int = PROMOTE_AT, most: int = 100) -> DataFrame:
    """(document): concepts that notes link to and that have no note yet, those mentioned most first."""
    first = G.dangling_concepts(concepts).limit(most)
    row = F.concat(F.lit("| [["), "slug", F.lit("]] | "), "mentions", F.lit(" | "), D.note_day(F.col("first_seen")), F.lit(" | "), D.note_day(F.col("last_seen")), F.lit(" |\n"))
    order = F.struct((-F.col("mentions")).alias("m"), (-F.unix_micros(F.col("last_seen").cast("timestamp"))).alias("t"), "slug", row.alias("row"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["row"]), "")
    head = F.concat(_head("index", as_of), F.lit(f"\n# Unresolved concepts\n\nConcepts the notes link to that have no Electron of their own. They get one at {promote_at} mention(s).\n\n"))
    return first.agg(rows.alias("_rows")).select(F.concat(head, F.when(F.col("_rows") == "", "Nothing pending — every concept mentioned so far has a note.\n").otherwise(F.concat(F.lit("| Concept | Mentions | First seen | Last seen |\n| --- | --- | --- | --- |\n"), F.col("_rows")))).alias("document"))


def daily_documents(notes: DataFrame, digests: DataFrame, as_of: Column, most: int = 200) -> DataFrame:
    """(day, document) of each day on which a note was made or whose digest (date, overview) says something: at most ``most`` notes of a day."""
    kinds = {"atom": "Notes added today", "electron": "Concepts that earned a note", "molecule": "Themes gathered today"}
    at = Window.partitionBy("day").orderBy("created_at", "id")
    made = notes.withColumn("day", D.note_day(F.col("created_at"))).withColumn("n", F.row_number().over(at)).where(F.col("n") <= most)
    lines = {k: F.transform(F.array_sort(F.collect_list(F.when(F.col("note_type") == k, F.struct("n", F.concat(F.lit("- [["), "slug", F.lit("]] — "), "title").alias("line"))))), lambda x: x["line"]).alias(k) for k in kinds}
    days = made.groupBy("day").agg(*lines.values())
    said = digests.where("overview <> ''").select(D.note_day(F.col("date")).alias("day"), "overview")
    both = days.join(said, "day", "full_outer")
    parts = [F.when(F.size(F.coalesce(k, F.array().cast("array<string>"))) > 0, F.concat(F.lit(f"## {title}\n"), F.array_join(k, "\n"), F.lit("\n\n"))).otherwise("") for k, title in kinds.items()]
    digest = F.when(F.col("overview").isNotNull(), F.concat(F.lit("## Digest\n"), "overview", F.lit("\n\n"))).otherwise("")
    return both.select("day", F.concat(_head("daily", as_of), F.lit("\n# "), "day", F.lit("\n\n"), digest, *parts).alias("document"))
