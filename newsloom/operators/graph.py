"""Concepts, notes and the links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import canon_key, display_name
from newsloom.operators.allocate import free_names, in_turn
from newsloom.operators.articles import since
from newsloom.operators.documents import redirect_document
from newsloom.operators.tables import checkpointed, numbered_within, upsert

GENERIC_TAGS = ("ai", "atom", "concept", "synthesis")


def resolve_concepts(slugs: DataFrame, aliases: DataFrame, concepts: DataFrame) -> DataFrame:
    """(slug, concept): the alias's target, else the most mentioned concept of the same spelling key, else the slug itself."""
    best = concepts.groupBy("canon_key").agg(F.min_by("slug", F.struct((-F.col("mentions")).alias("m"), "slug")).alias("_best"))
    own = slugs.select("slug").distinct().withColumn("canon_key", canon_key(F.col("slug")))
    out = own.join(aliases.select(F.col("alias").alias("slug"), "canonical"), "slug", "left").join(best, "canon_key", "left")
    return out.select("slug", F.coalesce("canonical", "_best", "slug").alias("concept"))


def fold_spellings(batch: DataFrame) -> DataFrame:
    """(slug, concept): within a batch (id, slug) the first spelling of a key by article, then by slug, stands for all."""
    own = batch.withColumn("canon_key", canon_key(F.col("slug")))
    first = own.groupBy("canon_key").agg(F.min_by("slug", F.struct("id", "slug")).alias("concept"))
    return own.select("slug", "canon_key").distinct().join(first, "canon_key").select("slug", "concept")


def allocate_concept_slugs(concepts: DataFrame, owners: DataFrame, tries: int = 10) -> DataFrame:
    """(slug, note_slug): the first of c, c-concept, c-concept-2 … that no note of another kind owns and no smaller slug of ``concepts`` takes.

    ``owners``: slug. Where all are taken it is c-concept, whoever has it.
    """
    names = F.array(F.col("slug"), F.concat("slug", F.lit("-concept")), *[F.concat("slug", F.lit(f"-concept-{i}")) for i in range(2, tries + 1)])
    free = free_names(concepts.select(F.col("slug").alias("key"), names.alias("names")).distinct(), owners.select(F.col("slug").alias("name")))
    given = in_turn(free.withColumn("k", F.lit(1)))
    return given.select(F.col("key").alias("slug"), F.coalesce("name", F.concat("key", F.lit("-concept"))).alias("note_slug"))


def _name_parts(slug: Column) -> tuple[Column, Column]:
    """The base and the number of a name like base-2; the number is null if the name isn't one."""
    number = F.nullif(F.regexp_extract(slug, r"-([1-9][0-9]{0,17})\z", 1), F.lit("")).cast("long")
    return F.regexp_replace(slug, r"-[0-9]+\z", ""), F.when(number >= 2, number)


def allocate_note_slugs(articles: DataFrame, owners: DataFrame, tries: int | None = None) -> DataFrame:
    """(id, note_slug): the first of base, base-2, base-3 … that neither ``owners`` (slug) nor an article of smaller id has.

    With ``tries`` only so many names are tried; after them it is the next number, whoever has it.

    A name is wanted by the articles of one base and, if it is itself a base, by that one's first article: no other can have it. So
    the n-th article of a base has its n-th name, moved on by those that owners have (as runs of numbers) and those that went to
    the other side. Who gets a name that two bases want is settled in rounds: each compares the first article of the one with the
    article of the other that gets there, given what the round before settled. Names settle from the shorter bases to the
    longer, and from small numbers to large ones, so what no round changes is what asking in order would give.
    """
    rows = checkpointed(numbered_within(articles.select("id", F.col("slug").alias("base")), "base", "n", "id"))
    bases = checkpointed(rows.where("n = 1").select("base", F.col("id").alias("first")))
    stem, number = _name_parts(F.col("slug"))
    within = F.lit(True) if tries is None else F.col("k") <= tries
    names = owners.select("slug").distinct()
    owned = names.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("k")).unionByName(names.select(stem.alias("base"), number.alias("k")).where("k IS NOT NULL"))
    owned = numbered_within(owned.where(within).join(bases.select("base"), "base", "left_semi"), "base", "j", "k")
    runs = owned.groupBy("base", (F.col("k") - F.col("j")).alias("_free")).agg(F.min("k").alias("k"), F.count("*").alias("w")).select("base", "k", "w")
    runs = checkpointed(runs)
    stem, number = _name_parts(F.col("base"))
    edges = bases.select(stem.alias("parent"), number.alias("k"), F.col("base").alias("child"), "first").where(F.col("k").isNotNull() & within)
    edges = edges.join(bases.select(F.col("base").alias("parent")), "parent", "left_semi").join(names.select(F.col("slug").alias("child")), "child", "left_anti")
    edges = checkpointed(edges.withColumn("child_has", F.lit(True)))

    def gone() -> DataFrame:
        """(base, k, w, child): the names that a base can't have, and those it may lose or has got (w is 0)."""
        none = F.lit(None).cast("string").alias("child")
        lost = edges.select(F.col("parent").alias("base"), "k", F.col("child_has").cast("long").alias("w"), "child")
        first = edges.where("NOT child_has").select(F.col("child").alias("base"), F.lit(1).cast("long").alias("k"), F.lit(1).cast("long").alias("w"), none)
        every = runs.select("base", "k", "w", none).unionByName(lost).unionByName(first)
        below = F.coalesce(F.sum("w").over(Window.partitionBy("base").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return every.withColumn("free", F.col("k") - 1 - below)

    while not edges.isEmpty():
        asked = gone().where("child IS NOT NULL").select("child", "base", (F.col("free") + 1).alias("n"))
        there = asked.join(rows.select("base", "n", F.col("id").alias("_rival")), ["base", "n"], "left").select("child", "_rival")
        judged = checkpointed(edges.join(there, "child").withColumn("_now", F.col("_rival").isNull() | (F.col("first") < F.col("_rival"))))
        edges = judged.select("parent", "k", "child", "first", F.col("_now").alias("child_has"))
        if judged.where("_now <> child_has").isEmpty():
            break
    moves = gone().where("w > 0").groupBy("base", "free").agg(F.sum("w").alias("w")).groupBy("base").agg(F.collect_list(F.struct("free", "w")).alias("moves"))
    moved = F.aggregate(F.coalesce("moves", F.array().cast("array<struct<free:bigint,w:bigint>>")), F.col("n"), lambda k, m: k + F.when(m["free"] < F.col("n"), m["w"]).otherwise(0))
    given = rows.join(moves, "base", "left").select("id", "base", moved.alias("k"))
    k = F.col("k") if tries is None else F.least("k", F.lit(tries + 1))
    return given.select("id", F.when(k == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), k)).alias("note_slug"))


def set_links(notes: DataFrame) -> DataFrame:
    """(from_note, to_slug) of all wikilinks, each once, empty ones left out."""
    return notes.select(F.col("id").alias("from_note"), F.explode("wikilinks").alias("to_slug")).where("to_slug <> ''").distinct()


def record_mentions(mentions: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, concepts): facts (concept_slug, note_id, created_at) of both tables once, and their counts and dates."""
    both = mentions.unionByName(incoming).groupBy("concept_slug", "note_id").agg(F.min("created_at").alias("created_at"))
    return both, both.groupBy(F.col("concept_slug").alias("slug")).agg(F.count("*").alias("mentions"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def user_note_mentions(notes: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(concept_slug, note_id) of wikilinks that resolve to a concept that there is."""
    links = set_links(notes)
    resolved = resolve_concepts(links.select(F.col("to_slug").alias("slug")), aliases, concepts)
    found = links.join(resolved, links.to_slug == resolved.slug).select(F.col("concept").alias("concept_slug"), F.col("from_note").alias("note_id"))
    return found.join(concepts.select(F.col("slug").alias("concept_slug")), "concept_slug", "left_semi").distinct()


def promote_concepts(concepts: DataFrame, owners: DataFrame, least: int = 2) -> DataFrame:
    """Concepts without a note that are mentioned enough and whose slug no note of another kind owns."""
    return concepts.where(F.col("note_id").isNull() & (F.col("mentions") >= least)).join(owners.select("slug"), "slug", "left_anti")


def dangling_concepts(concepts: DataFrame) -> DataFrame:
    return concepts.where("note_id IS NULL AND mentions > 0").orderBy(F.desc("mentions"), F.desc("last_seen"), "slug")


def top_concepts(concepts: DataFrame, limit: int) -> DataFrame:
    return concepts.orderBy(F.desc("mentions"), "slug").limit(limit)


def concept_pairs(mentions: DataFrame) -> DataFrame:
    """(a, b, shared) of concepts that share notes, either way round. A note names a handful of concepts, so notes are joined on themselves."""
    m = mentions.select("concept_slug", "note_id").distinct()
    pairs = m.alias("x").join(m.alias("y"), F.col("x.note_id") == F.col("y.note_id")).where("x.concept_slug <> y.concept_slug")
    return pairs.groupBy(F.col("x.concept_slug").alias("a"), F.col("y.concept_slug").alias("b")).agg(F.count("*").alias("shared"))


def co_occurring(mentions: DataFrame, limit: int = 8) -> DataFrame:
    """(slug, related, shared): the concepts that share most notes with each."""
    at = Window.partitionBy("a").orderBy(F.desc("shared"), "b")
    return concept_pairs(mentions).withColumn("n", F.row_number().over(at)).where(F.col("n") <= limit).select(F.col("a").alias("slug"), F.col("b").alias("related"), "shared")


def mentions_by_month(mentions: DataFrame) -> DataFrame:
    return mentions.groupBy(F.col("concept_slug").alias("slug"), F.date_format("created_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def mentions_since(mentions: DataFrame, notes: DataFrame, as_of: Column, days: int, limit: int | None = 5000) -> DataFrame:
    """Mentions in the window by notes that aren't electrons, the newest first."""
    own = mentions.where(since("created_at", as_of, days)).join(notes.where("note_type <> 'electron'").select(F.col("id").alias("note_id")), "note_id", "left_semi")
    return own if limit is None else own.orderBy(F.desc("created_at"), F.desc("note_id"), "concept_slug").limit(limit)


def incoming_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(slug, from_note, title) of links whose target note there is."""
    sources = notes.select(F.col("id").alias("from_note"), "title")
    return links.join(notes.select(F.col("slug").alias("to_slug")), "to_slug", "left_semi").join(sources, "from_note").select(F.col("to_slug").alias("slug"), "from_note", "title")


def co_mentioned(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(note, other) of notes that link to a slug that ``notes`` (id) link to."""
    own = links.join(notes.select(F.col("id").alias("from_note")), "from_note", "left_semi")
    return own.alias("x").join(links.alias("y"), F.col("x.to_slug") == F.col("y.to_slug")).where("x.from_note <> y.from_note").select(F.col("x.from_note").alias("note"), F.col("y.from_note").alias("other")).distinct()


def shared_tag_notes(notes: DataFrame) -> DataFrame:
    """(tag, id, others): the notes of each specific tag, and how many others have it: notes that share it are one class."""
    tags = notes.select("id", F.explode(F.array_distinct("tags")).alias("tag")).where(~F.col("tag").isin(*GENERIC_TAGS))
    return _with_class_size(tags, "tag", F.col("_n") - 1).select("tag", "id", F.col("_size").alias("others"))


def _with_class_size(rows: DataFrame, key: str, size: Column) -> DataFrame:
    """``rows`` with ``_size`` of their class, which is counted before it is joined."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n")).withColumn("_size", size).drop("_n")
    return rows.join(sizes, key)


def _first_of_class(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The ``most`` smallest ids of each class of ``rows`` (key, other): partial lists are cut before they are merged."""
    at = Window.partitionBy(key).orderBy("other")
    return rows.withColumn("_n", F.row_number().over(at)).where(F.col("_n") <= most).drop("_n")


def graph_neighbors(notes: DataFrame, links: DataFrame, wanted: DataFrame, limit: int = 50) -> DataFrame:
    """(note, other, tier): outgoing, incoming, co-mentioned, then notes of a shared tag; each other note once, the first tier counts.

    Of a slug or tag only the first ``limit`` + 1 notes are looked at: whatever of them an earlier tier has already
    is among the ``limit`` that are kept.
    """
    slug = notes.select(F.col("id").alias("other"), F.col("slug").alias("to_slug"))
    me = wanted.select(F.col("id").alias("note"), F.col("slug").alias("_slug"))
    out = links.withColumnRenamed("from_note", "note").join(me.select("note"), "note", "left_semi").join(slug, "to_slug").select("note", "other", F.lit(1).alias("tier"))
    into = links.join(me, F.col("to_slug") == F.col("_slug")).select("note", F.col("from_note").alias("other"), F.lit(2).alias("tier"))
    together = links.withColumnRenamed("from_note", "note").join(me.select("note"), "note", "left_semi").select("note", "to_slug").join(_first_of_class(links.select("to_slug", F.col("from_note").alias("other")).distinct(), "to_slug", limit + 1), "to_slug")
    tags = notes.select(F.col("id").alias("other"), F.explode("tags").alias("tag")).where(~F.col("tag").isin(*GENERIC_TAGS)).distinct()
    tagged = wanted.select(F.col("id").alias("note"), F.explode("tags").alias("tag")).distinct().join(_first_of_class(tags, "tag", limit + 1), "tag")
    every = out.unionByName(into).unionByName(together.select("note", "other", F.lit(3).alias("tier"))).unionByName(tagged.select("note", "other", F.lit(4).alias("tier")))
    first = every.where("note <> other").groupBy("note", "other").agg(F.min("tier").alias("tier"))
    at = Window.partitionBy("note").orderBy("tier", "other")
    return first.withColumn("n", F.row_number().over(at)).where(F.col("n") <= limit).drop("n")


def graph_edges(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Undirected note-note edges (a, b) of links that resolve, no loops."""
    target = notes.select(F.col("id").alias("to_note"), F.col("slug").alias("to_slug"))
    return links.join(target, "to_slug").where("from_note <> to_note").select(F.least("from_note", "to_note").alias("a"), F.greatest("from_note", "to_note").alias("b")).distinct()


def note_links(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(note, other, direction) of links that resolve."""
    both = links.join(notes.select(F.col("id").alias("to_note"), F.col("slug").alias("to_slug")), "to_slug")
    out = both.select(F.col("from_note").alias("note"), F.col("to_note").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(both.select(F.col("to_note").alias("note"), F.col("from_note").alias("other"), F.lit("in").alias("direction"))).distinct()


def backfill_graph(notes: DataFrame) -> DataFrame:
    """(slug, note_id, mentions) of concepts from notes alone: electrons, and link targets that are no note."""
    links = set_links(notes)
    electrons = notes.where("note_type = 'electron'").select("slug", F.col("id").alias("note_id"))
    unknown = links.select(F.col("to_slug").alias("slug")).distinct().join(notes.select("slug"), "slug", "left_anti").withColumn("note_id", F.lit(None).cast("long"))
    atoms = links.join(notes.where("note_type = 'atom'").select(F.col("id").alias("from_note")), "from_note", "left_semi").groupBy(F.col("to_slug").alias("slug")).agg(F.count("*").alias("n"))
    return electrons.unionByName(unknown).join(atoms, "slug", "left").select("slug", "note_id", F.coalesce("n", F.lit(0)).alias("mentions"))


def merge_plan(pairs: DataFrame, aliases: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(merges, refused) of ``pairs`` (from, to): what each ``from`` becomes in the end, and the pairs that lead round in a circle.

    A ``to`` that is itself merged, now or by ``aliases`` (alias, canonical), is followed to its end by pointer jumping, whose rounds
    grow with the logarithm of the longest chain. Of several pairs of one ``from`` the smallest ``to`` counts.
    """
    own = pairs.groupBy("from").agg(F.min("to").alias("to")).where(F.col("from").isNotNull() & F.col("to").isNotNull())
    links = own
    if aliases is not None:
        older = aliases.select(F.col("alias").alias("from"), F.col("canonical").alias("to")).where("from <> to")
        links = own.unionByName(older.join(own, "from", "left_anti").groupBy("from").agg(F.min("to").alias("to")))
    # a chain of n links is at its end after as many doublings as n has bits; what still goes on then is a circle
    links = checkpointed(links)
    at, steps = links, 1
    total = links.count()
    while True:
        onward = at.select(F.col("from").alias("to"), F.col("to").alias("_next"))
        at = checkpointed(at.join(onward, "to", "left").select("from", F.coalesce("_next", "to").alias("to")))
        steps *= 2
        going = at.join(links.select(F.col("from").alias("to")), "to", "left_semi")
        if going.isEmpty() or steps > total:
            break
    ends = at.join(links.select(F.col("from").alias("to")), "to", "left_anti").select("from", "to")
    merges = ends.join(own.select("from"), "from", "left_semi")
    return merges, own.join(merges.select("from"), "from", "left_anti")


def merge_concepts(mentions: DataFrame, links: DataFrame, aliases: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, links, aliases) after each ``from`` of ``pairs`` has become its ``to``: facts once, older aliases re-pointed, new ones added.

    ``pairs`` are the merges of a ``merge_plan``, so no ``to`` is a ``from``.
    """
    p = pairs.select(F.col("from").alias("_from"), F.col("to").alias("_to"))

    def moved(df: DataFrame, column: str) -> DataFrame:
        return df.join(p, df[column] == p["_from"], "left").withColumn(column, F.coalesce("_to", column)).drop("_from", "_to")

    facts = moved(mentions, "concept_slug").groupBy("concept_slug", "note_id").agg(F.min("created_at").alias("created_at"))
    edges = moved(links.select("from_note", "to_slug"), "to_slug").distinct()
    named = upsert(moved(aliases, "canonical"), p.select(F.col("_from").alias("alias"), F.col("_to").alias("canonical")), ["alias"]).drop("created")
    return facts, edges, named


def merged_notes(notes: DataFrame, merges: DataFrame, names: DataFrame, created: Column) -> DataFrame:
    """(id, slug, content, wikilinks, change) of the notes (id, slug, title, content, wikilinks) that ``merges`` (from, to) change.

    ``relinked``: each [[from]] and [[from|label]] in the text leads to the concept it was merged into, and so do the links, each
    once. ``redirect``: the note of a merged concept only points on; ``names``: slug, name of concepts.
    """
    m = merges.select(F.col("from").alias("_from"), F.col("to").alias("_to"))
    gone = notes.join(m, F.col("slug") == F.col("_from")).join(names.select(F.col("slug").alias("_to"), F.col("name").alias("_name")), "_to", "left")
    redirect = gone.select("id", "slug", redirect_document(F.col("title"), F.coalesce("_name", "_to"), F.col("_to"), created).alias("content"), F.array("_to").alias("wikilinks"), F.lit("redirect").alias("change"))
    touched = notes.select("id", F.explode(F.array_distinct("wikilinks")).alias("_from")).join(m, "_from").groupBy("id").agg(F.collect_list(F.struct("_from", "_to")).alias("_moves"))
    own = notes.join(gone.select("id"), "id", "left_anti").join(touched, "id")

    def pointed(text: Column, move: Column) -> Column:
        for close in ("]]", "|"):
            text = F.replace(text, F.concat(F.lit("[["), move["_from"], F.lit(close)), F.concat(F.lit("[["), move["_to"], F.lit(close)))
        return text

    content = F.aggregate("_moves", F.coalesce("content", F.lit("")), pointed)
    moved = F.aggregate("_moves", F.col("wikilinks"), lambda links, move: F.transform(links, lambda x: F.when(x == move["_from"], move["_to"]).otherwise(x)))
    return own.select("id", "slug", content.alias("content"), F.array_distinct(moved).alias("wikilinks"), F.lit("relinked").alias("change")).unionByName(redirect)


def repair_names(concepts: DataFrame) -> DataFrame:
    """(slug, name) of concepts whose name is still their slug, as a reader should see them."""
    return concepts.where("name = slug").select("slug", display_name(F.col("slug")).alias("name"))


def tag_taxonomy(notes: DataFrame) -> DataFrame:
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def related_atoms(notes: DataFrame, articles: DataFrame) -> DataFrame:
    """(id, tag, atoms): the tags of articles (id, tags) that atoms have, and how many other atoms have each; the atoms of a tag are in ``shared_tag_notes``."""
    own = notes.where("note_type = 'atom'").select(F.col("id").alias("note"), F.explode(F.array_distinct("tags")).alias("tag"))
    counted = own.groupBy("tag").agg(F.count("*").alias("_n"))
    mine = own.select(F.col("note").alias("id"), "tag", F.lit(1).alias("_own"))
    asked = articles.select("id", F.explode(F.array_distinct("tags")).alias("tag")).join(counted, "tag").join(mine, ["id", "tag"], "left")
    return asked.select("id", "tag", (F.col("_n") - F.coalesce("_own", F.lit(0))).alias("atoms")).where("atoms > 0")


def category_concepts(notes: DataFrame, aliases: DataFrame, concepts: DataFrame, top: int = 6) -> DataFrame:
    """(category, concept, notes): what the atoms of a category link to most, counted once a note."""
    atoms = notes.where("note_type = 'atom'")
    links = set_links(atoms).join(atoms.select(F.col("id").alias("from_note"), "category"), "from_note")
    resolved = resolve_concepts(links.select(F.col("to_slug").alias("slug")), aliases, concepts)
    counted = links.join(resolved, links.to_slug == resolved.slug).select("category", "concept", "from_note").distinct().groupBy("category", "concept").agg(F.count("*").alias("notes"))
    at = Window.partitionBy("category").orderBy(F.desc("notes"), "concept")
    return counted.withColumn("n", F.row_number().over(at)).where(F.col("n") <= top).drop("n")


def newest_by_category(notes: DataFrame, most: int = 10) -> DataFrame:
    """(category, id, pos) of the newest atoms of each category."""
    at = Window.partitionBy("category").orderBy(F.desc("created_at"), "id")
    return notes.where("note_type = 'atom'").withColumn("pos", F.row_number().over(at)).where(F.col("pos") <= most).select("category", "id", "pos")


def coverage_links(articles: DataFrame) -> DataFrame:
    """(story_id, name, articles, first): the sources that cover each story of two or more, with their articles and the first of those.

    The other copies of an article's story are those rows but itself: a story has its list once, whatever its size.
    """
    own = articles.where("story_id <> 0").select("id", "story_id", F.coalesce(F.nullif("source_name", F.lit("")), "url").alias("name"))
    names = own.groupBy("story_id", "name").agg(F.count("*").alias("articles"), F.min("id").alias("first"))
    several = names.groupBy("story_id").agg(F.sum("articles").alias("_n")).where("_n >= 2")
    return names.join(several.select("story_id"), "story_id", "left_semi")


def build_preview(concepts: DataFrame, incoming: DataFrame, least: int = 2) -> DataFrame:
    """(slug, mentions, promoting): concepts as they would be after the incoming mentions (concept_slug, note_id)."""
    new = incoming.select("concept_slug", "note_id").distinct().groupBy(F.col("concept_slug").alias("slug")).agg(F.count("*").alias("n"))
    both = concepts.select("slug", "note_id", "mentions").join(new, "slug", "full_outer")
    total = F.coalesce("mentions", F.lit(0)) + F.coalesce("n", F.lit(0))
    return both.select("slug", total.alias("mentions"), (F.col("note_id").isNull() & (total >= least)).alias("promoting"))
