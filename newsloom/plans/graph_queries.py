"""Concept graph, notes, themes and digests over the domain views."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from newsloom.functions.text import slugify
from newsloom.operators import graph as G
from newsloom.operators.digest import daily_digest
from newsloom.operators.themes import cluster_themes, theme_summary
from newsloom.plans.article_queries import ART, storied
from newsloom.plans.core import query
from newsloom.plans.fixtures import AS_OF
from newsloom.plans.ingest_queries import now
from newsloom.plans.text_queries import SLUG

ALIASES = "al AS (SELECT DISTINCT to_slug AS alias, concat('area-', len(to_slug) % 3) AS canonical FROM f_links WHERE starts_with(to_slug, 'facet-1'))"
_RESOLVED = f"""{ALIASES}, best AS (SELECT canon_key, arg_min(slug, struct_pack(m := -mentions, s := slug)) AS b FROM f_concepts GROUP BY 1),
res AS (SELECT s.to_slug AS slug, coalesce(al.canonical, best.b, s.to_slug) AS concept FROM (SELECT DISTINCT to_slug FROM f_links) s LEFT JOIN al ON al.alias = s.to_slug LEFT JOIN best ON best.canon_key = replace(s.to_slug, '-', ''))"""


def _aliases(links):
    return links.where("to_slug LIKE 'facet-1%'").select(F.col("to_slug").alias("alias"), F.concat(F.lit("area-"), F.length("to_slug") % 3).alias("canonical")).distinct()


@query("resolve_concepts", "f_links", "f_concepts", sql=f"WITH {_RESOLVED} SELECT slug, concept FROM res")
def resolve_concepts(links, concepts):
    return G.resolve_concepts(links.select(F.col("to_slug").alias("slug")), _aliases(links), concepts)


@query("fold_spellings", "f_links", sql="WITH b AS (SELECT from_note AS id, CASE WHEN from_note % 2 = 0 THEN replace(to_slug, '-', '') ELSE to_slug END AS slug FROM f_links), k AS (SELECT *, replace(slug, '-', '') AS c FROM b), f AS (SELECT c, arg_min(slug, struct_pack(i := id, s := slug)) AS concept FROM k GROUP BY c) SELECT DISTINCT slug, concept FROM k JOIN f USING (c)")
def fold_spellings(links):
    return G.fold_spellings(links.select(F.col("from_note").alias("id"), F.when(F.col("from_note") % 2 == 0, F.replace("to_slug", F.lit("-"))).otherwise(F.col("to_slug")).alias("slug")))


@query(
    "allocate_concept_slugs",
    "f_concepts",
    sql="""SELECT slug, CASE WHEN starts_with(slug, 'area') THEN concat(slug, '-concept-2') ELSE slug END AS note_slug FROM f_concepts
  UNION ALL SELECT concat(slug, '-concept'), concat(slug, '-concept', CASE WHEN starts_with(slug, 'area') THEN '-concept' ELSE '' END) FROM f_concepts""",
)
def allocate_concept_slugs(concepts):
    """Every concept c beside a concept c-concept; other notes own c and c-concept of the areas."""
    both = concepts.select("slug").unionByName(concepts.select(F.concat("slug", F.lit("-concept")).alias("slug")))
    return G.allocate_concept_slugs(both, both.where("slug LIKE 'area%'"))


@query("allocate_note_slugs", "f_articles", "f_notes", sql=f"WITH r AS (SELECT id, s, row_number() OVER (PARTITION BY s ORDER BY id) AS n FROM (SELECT id, {SLUG.format('title')} AS s FROM f_articles)) SELECT id, CASE WHEN n = 1 THEN s ELSE concat(s, '-', n) END AS note_slug FROM r")
def allocate_note_slugs(a, n):
    """All articles are named anew, so their own atoms' names are free; those of other notes are taken."""
    return G.allocate_note_slugs(a.select("id", slugify(F.col("title")).alias("slug")), n.where("note_type <> 'atom'"))


@query("set_links", "f_notes", sql="SELECT from_note, to_slug FROM f_links")
def set_links(notes):
    return G.set_links(notes)


@query("record_mentions", "f_mentions", sql="SELECT slug, mentions, first_seen, last_seen FROM f_concepts")
def record_mentions(m):
    return G.record_mentions(m, m)[1]


@query("user_note_mentions", "f_notes", "f_concepts", "f_links", sql=f"WITH {_RESOLVED} SELECT DISTINCT r.concept AS concept_slug, l.from_note AS note_id FROM f_links l JOIN res r ON r.slug = l.to_slug JOIN f_concepts c ON c.slug = r.concept")
def user_note_mentions(notes, concepts, links):
    return G.user_note_mentions(notes, concepts, _aliases(links))


@query("promote_concepts", "f_concepts", sql="SELECT slug, mentions FROM f_concepts WHERE note_id IS NULL AND mentions >= 2 AND NOT starts_with(slug, 'area')")
def promote_concepts(c):
    return G.promote_concepts(c, c.where("slug LIKE 'area%'")).select("slug", "mentions")


@query("dangling_concepts", "f_concepts", sql="SELECT slug, mentions, last_seen FROM f_concepts WHERE note_id IS NULL")
def dangling_concepts(c):
    return G.dangling_concepts(c).select("slug", "mentions", "last_seen")


@query("top_concepts", "f_concepts", sql="SELECT slug, mentions FROM (SELECT slug, mentions FROM f_concepts ORDER BY mentions DESC, slug LIMIT 20)")
def top_concepts(c):
    return G.top_concepts(c, 20).select("slug", "mentions")


_PAIRS = "pr AS (SELECT x.concept_slug AS a, y.concept_slug AS b, count(*) AS shared FROM (SELECT DISTINCT concept_slug, note_id FROM f_mentions) x JOIN (SELECT DISTINCT concept_slug, note_id FROM f_mentions) y ON x.note_id = y.note_id AND x.concept_slug <> y.concept_slug GROUP BY ALL)"


@query("concept_pairs", "f_mentions", sql=f"WITH {_PAIRS} SELECT a, b, shared FROM pr")
def concept_pairs(m):
    return G.concept_pairs(m)


@query("co_occurring", "f_mentions", sql=f"WITH {_PAIRS} SELECT a AS slug, b AS related, shared FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY shared DESC, b) AS n FROM pr) WHERE n <= 8")
def co_occurring(m):
    return G.co_occurring(m)


@query("mentions_by_month", "f_mentions", sql="SELECT concept_slug AS slug, strftime(created_at, '%Y-%m') AS month, count(*) AS n FROM f_mentions GROUP BY ALL")
def mentions_by_month(m):
    return G.mentions_by_month(m)


@query("mentions_since", "f_mentions", "f_notes", sql=f"SELECT concept_slug, note_id FROM f_mentions WHERE created_at >= timestamp '{AS_OF}' - interval 14 day")
def mentions_since(m, n):
    return G.mentions_since(m, n, now(), 14, None).select("concept_slug", "note_id")


@query("incoming_links", "f_links", "f_notes", sql="SELECT l.to_slug AS slug, l.from_note, s.title FROM f_links l JOIN f_notes t ON t.slug = l.to_slug JOIN f_notes s ON s.id = l.from_note")
def incoming_links(links, n):
    return G.incoming_links(links, n)


_CO = "co AS (SELECT DISTINCT x.from_note AS note, y.from_note AS other FROM f_links x JOIN f_links y ON x.to_slug = y.to_slug AND x.from_note <> y.from_note)"
_TAGGED = "tg AS (SELECT id, unnest(tags) AS tag FROM f_notes), st AS (SELECT DISTINCT x.id AS note, y.id AS other FROM tg x JOIN tg y ON x.tag = y.tag AND x.id <> y.id WHERE x.tag NOT IN ('ai', 'atom', 'concept', 'synthesis'))"


@query("co_mentioned", "f_links", "f_notes", sql=f"WITH {_CO} SELECT note, other FROM co WHERE note % 100 = 0")
def co_mentioned(links, n):
    """For the notes whose id 100 divides, against all links."""
    return G.co_mentioned(links, n.where("id % 100 = 0"))


@query("shared_tag_notes", "f_notes", sql="WITH tg AS (SELECT DISTINCT id, unnest(tags) AS tag FROM f_notes) SELECT tag, id, count(*) OVER (PARTITION BY tag) - 1 AS others FROM tg WHERE tag NOT IN ('ai', 'atom', 'concept', 'synthesis')")
def shared_tag_notes(n):
    return G.shared_tag_notes(n)


@query("graph_neighbors", "f_notes", "f_links", sql=f"""WITH {_CO}, {_TAGGED}, ev AS (SELECT l.from_note AS note, n.id AS other, 1 AS tier FROM f_links l JOIN f_notes n ON n.slug = l.to_slug UNION ALL SELECT n.id, l.from_note, 2 FROM f_links l JOIN f_notes n ON n.slug = l.to_slug
 UNION ALL SELECT note, other, 3 FROM co UNION ALL SELECT note, other, 4 FROM st), g AS (SELECT note, other, min(tier) AS tier FROM ev WHERE note <> other GROUP BY ALL)
SELECT note, other, tier FROM (SELECT *, row_number() OVER (PARTITION BY note ORDER BY tier, other) AS n FROM g) WHERE n <= 50""")
def graph_neighbors(n, links):
    return G.graph_neighbors(n, links, n)


@query("graph_edges", "f_notes", "f_links", sql="SELECT DISTINCT least(l.from_note, n.id) AS a, greatest(l.from_note, n.id) AS b FROM f_links l JOIN f_notes n ON n.slug = l.to_slug WHERE l.from_note <> n.id")
def graph_edges(n, links):
    return G.graph_edges(n, links)


@query("note_links", "f_notes", "f_links", sql="WITH e AS (SELECT l.from_note AS f, n.id AS t FROM f_links l JOIN f_notes n ON n.slug = l.to_slug) SELECT f AS note, t AS other, 'out' AS direction FROM e UNION SELECT t, f, 'in' FROM e")
def note_links(n, links):
    return G.note_links(n, links)


@query("backfill_graph", "f_notes", sql="""WITH atm AS (SELECT to_slug AS slug, count(*) AS n FROM f_links l JOIN f_notes s ON s.id = l.from_note AND s.note_type = 'atom' GROUP BY 1)
SELECT s.slug, coalesce(atm.n, 0) AS mentions FROM (SELECT slug FROM f_notes WHERE note_type = 'electron' UNION SELECT to_slug FROM f_links WHERE to_slug NOT IN (SELECT slug FROM f_notes)) s LEFT JOIN atm ON atm.slug = s.slug""")
def backfill_graph(n):
    return G.backfill_graph(n).select("slug", "mentions")


def _merge(m, links, which):
    """facet-k becomes area-0 through area-9, which isn't there; topic-1 and topic-2 would become each other."""
    facets = m.select("concept_slug").distinct().where("concept_slug LIKE 'facet-%'").select(F.col("concept_slug").alias("from"), F.lit("area-9").alias("to"))
    more = m.sparkSession.createDataFrame([("area-9", "area-0"), ("topic-1", "topic-2"), ("topic-2", "topic-1")], "from string, to string")
    merges, refused = G.merge_plan(facets.unionByName(more))
    return refused if which is None else merges if which == "plan" else G.merge_concepts(m, links, _aliases(links), merges)[which]


@query("merge_plan", "f_mentions", "f_links", sql="SELECT DISTINCT concept_slug AS \"from\", 'area-0' AS \"to\", false AS refused FROM f_mentions WHERE starts_with(concept_slug, 'facet-') UNION ALL VALUES ('area-9', 'area-0', false), ('topic-1', 'topic-2', true), ('topic-2', 'topic-1', true)")
def merge_plan(m, links):
    return _merge(m, links, "plan").withColumn("refused", F.lit(False)).unionByName(_merge(m, links, None).withColumn("refused", F.lit(True)))


@query("merge_concepts", "f_mentions", "f_links", sql="SELECT DISTINCT CASE WHEN starts_with(concept_slug, 'facet-') THEN 'area-0' ELSE concept_slug END AS concept_slug, note_id FROM f_mentions")
def merge_concepts(m, links):
    return _merge(m, links, 0).select("concept_slug", "note_id")


@query("merged_links", "f_mentions", "f_links", sql="SELECT DISTINCT from_note, CASE WHEN starts_with(to_slug, 'facet-') THEN 'area-0' ELSE to_slug END AS to_slug FROM f_links")
def merged_links(m, links):
    return _merge(m, links, 1)


@query(
    "merged_notes",
    "f_notes",
    sql=f"""WITH x AS (SELECT id, slug, title, list_filter(wikilinks, lambda w: w IN ('topic-1', 'topic-3', 'area-1')) AS hit, list_distinct(list_transform(wikilinks, lambda w: CASE WHEN w IN ('topic-1', 'topic-3', 'area-1') THEN 'topic-2' ELSE w END)) AS moved, wikilinks FROM f_notes)
SELECT id, 'redirect' AS change, concat('---', chr(10), 'type: electron', chr(10), 'created: "2024-01-27 00:00"', chr(10), 'status: merged', chr(10), 'tags:', chr(10), '  - ai', chr(10), '  - concept', chr(10), '---', chr(10), chr(10), '# ', title, chr(10), chr(10), 'Merged into [[topic-2]] — Two.', chr(10)) AS content, 'topic-2' AS links FROM x WHERE slug IN ('topic-1', 'topic-3', 'area-1')
UNION ALL SELECT id, 'relinked', array_to_string(list_transform(wikilinks, lambda w: CASE WHEN w IN ('topic-1', 'topic-3', 'area-1') THEN '[[topic-2]] and [[topic-2|here]]' ELSE concat('[[', w, ']] and [[', w, '|here]]') END), ', '), array_to_string(list_sort(moved), ',') FROM x WHERE len(hit) > 0 AND slug NOT IN ('topic-1', 'topic-3', 'area-1')""",
)
def merged_notes(n):
    pairs = n.sparkSession.createDataFrame([("area-1", "topic-1"), ("topic-1", "topic-3"), ("topic-3", "topic-2")], "from string, to string")
    names = n.sparkSession.createDataFrame([("topic-2", "Two")], "slug string, name string")
    text = F.array_join(F.transform("wikilinks", lambda w: F.concat(F.lit("[["), w, F.lit("]] and [["), w, F.lit("|here]]"))), ", ")
    out = G.merged_notes(n.withColumn("content", text), G.merge_plan(pairs)[0], names, now())
    return out.select("id", "change", "content", F.array_join(F.array_sort("wikilinks"), ",").alias("links"))


@query("aliases", "f_mentions", "f_links", sql="SELECT DISTINCT to_slug AS alias, 'area-0' AS canonical FROM f_links WHERE starts_with(to_slug, 'facet-') UNION ALL SELECT 'area-9', 'area-0'")
def aliases(m, links):
    return _merge(m, links, 2)


@query("repair_names", "f_concepts", sql="SELECT slug, concat(upper(substring(slug, 1, 1)), substring(slug, 2)) AS name FROM f_concepts WHERE starts_with(slug, 'topic')")
def repair_names(c):
    return G.repair_names(c.withColumn("name", F.when(F.col("slug").startswith("topic"), F.col("slug")).otherwise("Named")))


@query("notes_by_category", "f_notes", sql="SELECT id, category FROM f_notes WHERE category = 'tools'")
def notes_by_category(n):
    return n.where("category = 'tools'").select("id", "category")


@query("note_categories", "f_notes", sql="SELECT DISTINCT category FROM f_notes WHERE category <> ''")
def note_categories(n):
    return n.where("category <> ''").select("category").distinct()


@query("notes_on_day", "f_notes", sql="SELECT CAST(created_at AS DATE) AS day, note_type, count(*) AS n FROM f_notes GROUP BY ALL")
def notes_on_day(n):
    return n.groupBy(F.to_date("created_at").alias("day"), "note_type").agg(F.count("*").alias("n"))


@query("daily_notes", "f_notes", sql="SELECT CAST(created_at AS DATE) AS day, array_to_string(list(slug ORDER BY slug), ',') AS slugs FROM (SELECT *, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, id) AS k FROM f_notes) WHERE k <= 200 GROUP BY ALL")
def daily_notes(n):
    """The first 200 notes of each day."""
    at = Window.partitionBy("day").orderBy("created_at", "id")
    first = n.withColumn("day", F.to_date("created_at")).withColumn("k", F.row_number().over(at)).where(F.col("k") <= 200)
    return first.groupBy("day").agg(F.array_join(F.array_sort(F.collect_list("slug")), ",").alias("slugs"))


@query("tag_taxonomy", "f_notes", sql="SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM f_notes) GROUP BY tag")
def tag_taxonomy(n):
    return G.tag_taxonomy(n)


@query("related_atoms", "f_notes", "f_articles", sql="WITH t AS (SELECT DISTINCT id, unnest(tags) AS tag FROM f_notes WHERE note_type = 'atom'), a AS (SELECT DISTINCT id, unnest(tags) AS tag FROM f_articles) SELECT a.id, tag, count(*) AS atoms FROM a JOIN t USING (tag) WHERE a.id <> t.id GROUP BY ALL")
def related_atoms(n, a):
    return G.related_atoms(n, a)


@query("category_concepts", "f_notes", "f_links", "f_concepts", sql=f"""WITH {_RESOLVED}, c AS (SELECT category, concept, count(DISTINCT id) AS notes FROM (SELECT n.category, n.id, r.concept FROM f_notes n JOIN f_links l ON l.from_note = n.id JOIN res r ON r.slug = l.to_slug WHERE n.note_type = 'atom') GROUP BY ALL)
SELECT category, concept, notes FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY notes DESC, concept) AS k FROM c) WHERE k <= 6""")
def category_concepts(n, links, c):
    return G.category_concepts(n, _aliases(links), c)


@query("index_by_category", "f_notes", sql="SELECT category, id, CAST(pos AS INTEGER) AS pos FROM (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY created_at DESC, id) AS pos FROM f_notes WHERE note_type = 'atom') WHERE pos <= 10")
def index_by_category(n):
    return G.newest_by_category(n)


@query("coverage_links", "f_articles", "f_sources", sql=ART + "SELECT a.story_id, s.name, count(*) AS articles, min(a.id) AS first FROM art a JOIN f_sources s ON s.id = a.source_id WHERE a.story_id <> 0 GROUP BY ALL")
def coverage_links(a, s):
    return G.coverage_links(storied(a).join(s.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id"))


@query("build_preview", "f_concepts", "f_mentions", sql="WITH n AS (SELECT concept_slug AS slug, count(DISTINCT note_id) AS n FROM f_mentions GROUP BY 1) SELECT c.slug, c.mentions + n.n AS mentions, c.note_id IS NULL AND c.mentions + n.n >= 2 AS promoting FROM f_concepts c JOIN n USING (slug)")
def build_preview(c, m):
    return G.build_preview(c, m)


def _themes(m):
    return cluster_themes(m, m.where("concept_slug LIKE 'area-%'").select(F.col("concept_slug").alias("slug"), F.regexp_extract("concept_slug", "([0-9]+)$", 1).cast("int").alias("pos")).distinct())


@query("cluster_themes", "f_mentions")
def themes(m):
    return _themes(m)


@query("theme_summary", "f_mentions", "f_notes")
def summary(m, n):
    return theme_summary(_themes(m), m, n)


@query("daily_digest", "f_articles", sql=f"""WITH r AS (SELECT coalesce(nullif(category, ''), 'general') AS theme, id, row_number() OVER (PARTITION BY coalesce(nullif(category, ''), 'general') ORDER BY importance DESC, published DESC NULLS LAST, fetched_at DESC, id) AS pos
 FROM f_articles WHERE status <> 'archived' AND fetched_at >= timestamp '{AS_OF}' - interval 7 day) SELECT theme, array_to_string(list(id ORDER BY pos), ',') AS articles FROM r WHERE pos <= 5 GROUP BY theme""")
def digest(a):
    return daily_digest(a, now()).select("theme", F.array_join(F.transform("articles", lambda x: x["id"].cast("string")), ",").alias("articles"))
