"""Changes to kept tables and rendered documents, over the domain views."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions.text import display_name
from newsloom.operators import documents as D
from newsloom.operators import graph as G
from newsloom.operators import knowledge as K
from newsloom.operators import records as R
from newsloom.operators.themes import theme_views
from newsloom.plans.core import query
from newsloom.plans.fixtures import AS_OF
from newsloom.plans.graph_queries import _themes
from newsloom.plans.ingest_queries import now

_NOW = f"timestamp '{AS_OF}'"
_OP = "CASE id % 6 WHEN 0 THEN 'delete' WHEN 1 THEN 'hide' WHEN 2 THEN 'disable' WHEN 3 THEN 'enable' WHEN 4 THEN 'update' END"
_CHANGED = f"""s AS (SELECT id, name, group_name, enabled, hidden, {_OP} AS op FROM f_sources),
changed AS (SELECT id, CASE op WHEN 'update' THEN concat('new ', name) ELSE name END AS name, group_name, CASE op WHEN 'enable' THEN true WHEN 'disable' THEN false ELSE enabled END AS enabled,
  hidden OR coalesce(op = 'hide', false) AS hidden, CASE WHEN op IS NULL THEN timestamp '2024-01-01 00:00:00' ELSE {_NOW} END AS updated_at FROM s WHERE op IS NULL OR op <> 'delete'
UNION ALL SELECT (SELECT max(id) FROM s) + row_number() OVER (ORDER BY id), concat('copy ', name), NULL, enabled, NULL, {_NOW} FROM s WHERE id % 5 = 0)"""


def _sources(s):
    table = s.select("id", "name", "group_name", "enabled", "hidden", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"))
    op = F.when(F.col("id") % 6 == 0, "delete").when(F.col("id") % 6 == 1, "hide").when(F.col("id") % 6 == 2, "disable").when(F.col("id") % 6 == 3, "enable").when(F.col("id") % 6 == 4, "update")
    changes = s.select("id", op.alias("op"), F.concat(F.lit("new "), "name").alias("name"), F.lit(None).cast("boolean").alias("enabled")).where("op IS NOT NULL")
    made = s.where("id % 5 = 0").select("id", F.lit("create").alias("op"), F.concat(F.lit("copy "), "name").alias("name"), "enabled")
    return R.change_records(table, changes.unionByName(made), now())


@query("change_sources", "f_sources", sql=f"WITH {_CHANGED} SELECT id, name, coalesce(group_name, '') AS group_name, enabled, coalesce(hidden, false) AS hidden, updated_at FROM changed")
def change_sources(s):
    return _sources(s).select("id", "name", F.coalesce("group_name", F.lit("")).alias("group_name"), "enabled", F.coalesce("hidden", F.lit(False)).alias("hidden"), "updated_at")


@query("orphaned_articles", "f_articles", "f_sources", sql=f"WITH {_CHANGED} SELECT id, source_id FROM f_articles WHERE source_id NOT IN (SELECT id FROM changed)")
def orphaned_articles(a, s):
    return R.orphaned_articles(a, _sources(s)).select("id", "source_id")


@query("change_stars", "f_articles", sql=f"SELECT id, CASE WHEN id % 3 = 0 THEN id % 2 = 0 ELSE starred END AS starred, CASE WHEN id % 3 <> 0 THEN '' WHEN id % 2 = 0 THEN 'starred' ELSE 'unstarred' END AS event FROM f_articles")
def change_stars(a):
    changes = a.where("id % 3 = 0").select("id", (F.col("id") % 2 == 0).alias("starred")).unionByName(a.agg((F.max("id") + 1).alias("id"), F.lit(True).alias("starred")))
    after, events = R.change_stars(a, changes, now())
    return after.join(events.select(F.col("article_id").alias("id"), "event"), "id", "left").select("id", "starred", F.coalesce("event", F.lit("")).alias("event"))


@query("save_digest", "f_articles", sql=f"SELECT CAST(fetched_at AS DATE) AS date, CASE WHEN day(fetched_at) % 2 = 0 THEN 'new' ELSE 'old' END AS overview, count(*) AS articles, CASE WHEN day(fetched_at) % 2 = 0 THEN {_NOW} ELSE timestamp '2024-01-01 00:00:00' END AS created_at FROM f_articles GROUP BY ALL")
def save_digest(a):
    days = a.groupBy(F.to_date("fetched_at").alias("date")).agg(F.count("*").alias("themes"))
    stored = days.select("date", F.lit("old").alias("overview"), "themes", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    new = days.where(F.dayofmonth("date") % 2 == 0).select("date", F.lit("new").alias("overview"), "themes")
    return R.save_digest(stored, new, now()).withColumnRenamed("themes", "articles")


@query("record_ingests", "f_articles", sql=f"SELECT 'article' AS ref_type, guid AS ref_id, id * 2 AS note_id, CASE WHEN id % 2 = 0 AND id % 5 = 0 THEN 'failed' WHEN id % 2 = 0 THEN 'processed' ELSE 'old' END AS status, CASE WHEN id % 3 = 0 OR id % 2 = 1 THEN fetched_at ELSE {_NOW} END AS created_at FROM f_articles WHERE id % 2 = 0 OR id % 3 = 0")
def record_ingests(a):
    reference = [F.lit("article").alias("ref_type"), F.col("guid").alias("ref_id"), (F.col("id") * 2).alias("note_id")]
    ledger = a.where("id % 3 = 0").select(*reference, F.lit("old").alias("status"), F.col("fetched_at").alias("created_at"))
    return R.record_ingests(ledger, a.where("id % 2 = 0").select(*reference, F.when(F.col("id") % 5 == 0, "failed").otherwise("").alias("status")), now())


@query("known_ingests", "f_articles", sql="SELECT guid AS ref_id, id % 3 = 0 AS known, CASE WHEN id % 3 = 0 THEN id * 2 ELSE 0 END AS note_id FROM f_articles")
def known_ingests(a):
    reference = [F.lit("article").alias("ref_type"), F.col("guid").alias("ref_id")]
    ledger = a.where("id % 3 = 0").select(*reference, (F.col("id") * 2).alias("note_id"))
    return R.known_ingests(a.select(*reference), ledger).select("ref_id", "known", "note_id")


def _atoms(a, s):
    """Articles with two entities, their tags as concepts, and for every third another outlet."""
    name = s.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    entity = lambda n, t: F.struct(n.alias("name"), F.lit(t).alias("type"))
    entities = F.when(F.col("id") % 2 == 0, F.array(entity(F.concat(F.lit("E"), F.col("id").cast("string")), "org"), entity(F.lit("Ada"), "person"))).otherwise(F.array().cast("array<struct<name:string,type:string>>"))
    outlet = F.struct(F.concat(F.lit("o"), F.col("id").cast("string")).alias("name"), F.col("url").alias("url"))
    coverage = F.when(F.col("id") % 3 == 0, F.array(outlet)).otherwise(F.array().cast("array<struct<name:string,url:string>>"))
    return a.join(name, "source_id").withColumns({"entities": entities, "coverage": coverage, "concepts": F.col("tags")})


_QUOTED = r"""CASE WHEN regexp_matches({0}, '[:#\[\]{{}}&*!|>''"%@`,]|^[\-?]|^\s|\s$|^$') THEN concat('"', replace(replace({0}, '\', '\\'), '"', '\"'), '"') ELSE {0} END"""
_TRIMMED = r"regexp_replace(content_md, '^\s+|\s+$', '', 'g')"
_ATOM = rf"""SELECT a.id, concat('---', chr(10), 'type: atom', chr(10), 'created: "', strftime(coalesce(published, fetched_at), '%Y-%m-%d %H:%M'), '"', chr(10), 'source: ', {_QUOTED.format('s.name')}, chr(10), 'url: ', {_QUOTED.format('a.url')}, chr(10),
  'rating: ', repeat('★', importance), repeat('☆', 5 - importance), chr(10), CASE WHEN category = '' THEN '' ELSE concat('category: ', category, chr(10)) END, 'tags:', chr(10), '  - atom', chr(10), '  - ai', chr(10),
  array_to_string(list_transform(tags, lambda t: concat('  - ', t, chr(10))), ''), '---', chr(10), chr(10), '# ', title, chr(10), chr(10), CASE WHEN summary = '' THEN '' ELSE concat('## Resumen', chr(10), summary, chr(10), chr(10)) END,
  CASE WHEN content_md = '' THEN '' ELSE concat('## Contenido destacado', chr(10), CASE WHEN len({_TRIMMED}) > 600 THEN concat(left({_TRIMMED}, 600), ' …') ELSE {_TRIMMED} END, chr(10), chr(10)) END,
  CASE WHEN a.id % 2 = 0 THEN concat('## Entidades', chr(10), '- **E', a.id, '** (org)', chr(10), '- **Ada** (person)', chr(10), chr(10)) ELSE '' END, '## Fuente', chr(10), '[', s.name, '](', a.url, ')', chr(10),
  CASE WHEN a.id % 3 = 0 THEN concat(chr(10), 'Also covered by 1 other outlet(s):', chr(10), '- [o', a.id, '](', a.url, ')', chr(10)) ELSE '' END, chr(10), '## Conexiones', chr(10), array_to_string(list_transform(tags, lambda t: concat('- [[', t, ']]', chr(10))), ''), chr(10)) AS document
FROM f_articles a JOIN f_sources s ON s.id = a.source_id"""


@query("render_atoms", "f_articles", "f_sources", sql=_ATOM)
def render_atoms(a, s):
    return D.render_atoms(_atoms(a, s))


@query("refresh_atoms", "f_articles", "f_sources", sql="SELECT id, CASE WHEN category = 'tools' THEN 'rewritten' ELSE 'fresh' END AS outcome FROM f_articles")
def refresh_atoms(a, s):
    own = _atoms(a, s)
    old = D.render_atoms(own.withColumn("title", F.when(F.col("category") == "tools", F.concat("title", F.lit(" (old)"))).otherwise(F.col("title"))))
    return K.refresh_atoms(D.render_atoms(own), old)


_ELECTRON = rf"""WITH src AS (SELECT x.concept_slug AS slug, count(*) AS n, array_to_string(list(concat('- [[', x.slug, ']] — ', x.title, chr(10)) ORDER BY x.slug, x.title), '') AS t FROM (SELECT m.concept_slug, n.slug, n.title, row_number() OVER (PARTITION BY m.concept_slug ORDER BY n.created_at DESC, n.id DESC) AS k FROM (SELECT DISTINCT concept_slug, note_id FROM f_mentions) m JOIN f_notes n ON n.id = m.note_id) x WHERE k <= 500 GROUP BY 1),
mo AS (SELECT concept_slug AS slug, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM f_mentions GROUP BY ALL), tl AS (SELECT slug, array_to_string(list(concat('- ', month, ' · ', n, ' mention(s)  ', repeat('▁', least(n, 20)), chr(10)) ORDER BY month), '') AS t FROM mo GROUP BY 1)
SELECT slug, concat('---', chr(10), 'type: electron', chr(10), 'created: "2024-01-27 00:00"', chr(10), 'status: active', chr(10), 'tags:', chr(10), '  - ai', chr(10), '  - concept', chr(10), '---', chr(10), chr(10), '# ', slug, chr(10), chr(10), '## Definition', chr(10),
  'A recurring idea in the feed, named in ', src.n, ' note(s).', chr(10), chr(10), '## When it comes up', chr(10), tl.t, chr(10), '## Sources', chr(10), src.t, chr(10)) AS document FROM src JOIN tl USING (slug)"""


def _sources_of(m, n, most=500):
    """The newest notes of each concept, by slug."""
    source = n.select(F.col("id").alias("note_id"), F.struct("slug", "title").alias("s"), "created_at")
    newest = Window.partitionBy("concept_slug").orderBy(F.desc("created_at"), F.desc("note_id"))
    named = m.select("concept_slug", "note_id").distinct().join(source, "note_id").withColumn("k", F.row_number().over(newest)).where(F.col("k") <= most)
    return named.groupBy(F.col("concept_slug").alias("slug")).agg(F.array_sort(F.collect_list("s")).alias("sources"))


@query("render_electrons", "f_mentions", "f_notes", sql=_ELECTRON)
def render_electrons(m, n):
    """Without names, definitions and related concepts, whose rules have queries of their own."""
    sources = _sources_of(m, n)
    months = G.mentions_by_month(m).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("months"))
    views = sources.join(months, "slug").withColumns({"name": F.col("slug"), "definition": F.lit(None).cast("string"), "related": F.array().cast("array<struct<slug:string,name:string,shared:bigint>>")})
    return D.render_electrons(views, now())


@query("electron_documents", "f_mentions", "f_notes")
def electron_documents(m, n):
    """With display names and the concepts that each comes up with."""
    sources = _sources_of(m, n)
    months = G.mentions_by_month(m).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("month", "n"))).alias("months"))
    shared = F.struct((-F.col("shared")).alias("o"), F.col("related").alias("slug"), display_name(F.col("related")).alias("name"), "shared")
    related = G.co_occurring(m).groupBy("slug").agg(F.array_sort(F.collect_list(shared)).alias("related"))
    views = sources.join(months, "slug").join(related, "slug", "left").withColumns({"name": display_name(F.col("slug")), "definition": F.lit(None).cast("string")})
    return D.render_electrons(views, now())


@query("render_molecule", "f_mentions", "f_notes")
def render_molecule(m, n):
    return D.render_molecules(theme_views(_themes(m), m, n))
