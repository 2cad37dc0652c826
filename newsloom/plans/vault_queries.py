"""The knowledge base built over the domain views, and the documents that lead into it."""

from pyspark.sql import functions as F

from newsloom.operators import build as B
from newsloom.plans.core import query
from newsloom.plans.fixtures import AS_OF
from newsloom.plans.ingest_queries import now

_CAND = f"cand AS (SELECT * FROM f_articles WHERE classified AND importance >= 2 AND status <> 'archived' AND fetched_at >= timestamp '{AS_OF}' - interval 30 day), tg AS (SELECT id, unnest(tags) AS slug FROM cand), cn AS (SELECT slug, count(DISTINCT id) AS mentions FROM tg GROUP BY slug)"
_NOTES = "id long, note_type string, slug string, title string, category string, tags array<string>, wikilinks array<string>, frontmatter string, content string, content_hash string, created_at timestamp_ntz, updated_at timestamp_ntz"
_CONCEPTS = "slug string, name string, note_id long, mentions long, first_seen timestamp_ntz, last_seen timestamp_ntz"


def _empty(spark):
    tables = (_NOTES, "concept_slug string, note_id long, created_at timestamp_ntz", _CONCEPTS, "alias string, canonical string", "ref_type string, ref_id string, note_id long, status string, created_at timestamp_ntz")
    return B.Vault(*[spark.createDataFrame([], t) for t in tables])


def _runs(a, s, runs=2):
    """Runs over all articles, each over what the one before left: the vault after the last, and the counts of all."""
    spark = a.sparkSession
    entities = F.array().cast("array<struct<name:string,type:string>>").alias("entities")
    articles = a.join(s.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id").select("*", entities, F.col("fetched_at").alias("updated_at"), F.lit(0).alias("story_id"))
    own = spark.createDataFrame([("mine", "Mine", "[[topic-1]] [[nowhere]]", [], ["topic-1", "nowhere"])], "slug string, title string, content string, tags array<string>, wikilinks array<string>")
    vault, counts = _empty(spark), []
    for _ in range(runs):
        vault, some = B.build(vault, articles, own, now(), limit=None)
        counts.append(some)
    return vault, counts


@query("vault_build", "f_articles", "f_sources", sql=f"WITH {_CAND} SELECT slug, mentions + CASE WHEN slug = 'topic-1' THEN 1 ELSE 0 END AS mentions, mentions + CASE WHEN slug = 'topic-1' THEN 1 ELSE 0 END >= 2 AS noted FROM cn")
def vault_build(a, s):
    """Concepts after a run from nothing: counted over articles and the reader's note, with a note from two mentions on."""
    return _runs(a, s, 1)[0].concepts.select("slug", "mentions", F.col("note_id").isNotNull().alias("noted"))


@query(
    "vault_counts",
    "f_articles",
    "f_sources",
    sql=f"""WITH {_CAND}, one AS (SELECT 1 AS run, 'notes_imported' AS what, 1 AS n UNION ALL SELECT 1, 'atoms_created', count(*) FROM cand UNION ALL SELECT 1, 'concepts_tracked', count(*) FROM cn UNION ALL SELECT 1, 'atoms_refreshed', 0
  UNION ALL SELECT 1, 'electrons_created', count(*) FROM cn WHERE mentions >= 2 OR slug = 'topic-1' UNION ALL SELECT 1, 'electrons_updated', 0)
SELECT CAST(run AS INTEGER) AS run, what, CAST(n AS BIGINT) AS n FROM one UNION ALL SELECT 2, what, 0 FROM one""",
)
def vault_counts(a, s):
    """Themes are picked one after the other and have no SQL; the second run writes nothing."""
    _, (first, second) = _runs(a, s)
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return both.where("NOT startswith(what, 'molecules')").select("run", "what", "n")


_LF = "chr(10)"
_MAP = "concat('---', chr(10), 'type: {0}', chr(10), 'created: \"2024-01-27 00:00\"', chr(10), 'status: generated', chr(10), 'tags:', chr(10), '  - ai', chr(10), '  - {0}', chr(10), '---', chr(10))"


def _vault(notes, concepts):
    own = notes.select("id", "note_type", "slug", "title", "category", "created_at")
    return B.Vault(own, None, concepts.withColumn("name", F.upper("slug")), None, None)


@query(
    "index_document",
    "f_notes",
    "f_concepts",
    sql=f"""WITH top AS (SELECT * FROM f_concepts ORDER BY mentions DESC, slug LIMIT 40), t AS (SELECT string_agg(concat('- [[', slug, ']] — ', upper(slug), ' · ', mentions, ' mention(s)', CASE WHEN note_id IS NULL THEN ' *(no note yet)*' ELSE '' END), {_LF} ORDER BY mentions DESC, slug) AS t FROM top),
nw AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY created_at DESC, id) AS pos FROM f_notes WHERE note_type = 'atom' AND category <> ''), ct AS (SELECT category, string_agg(concat('- [[', slug, ']] — ', title), {_LF} ORDER BY pos) AS l FROM nw WHERE pos <= 10 GROUP BY category),
cs AS (SELECT string_agg(concat({_LF}, '### ', category, {_LF}, l, {_LF}), '' ORDER BY category) AS c FROM ct)
SELECT concat({_MAP.format('index')}, {_LF}, '# AI knowledge index', {_LF}, {_LF}, (SELECT count(*) FROM f_notes WHERE note_type = 'atom'), ' atoms · ', (SELECT count(*) FROM f_notes WHERE note_type = 'electron'), ' electrons · 0 molecules · ', (SELECT least(100, count(*)) FROM f_concepts WHERE note_id IS NULL), ' concepts waiting for one', {_LF}, {_LF},
  '## Most mentioned', {_LF}, t, {_LF}, {_LF}, '## By category', {_LF}, c, {_LF}) AS document FROM t, cs""",
)
def index_document(n, c):
    return B.index_document(_vault(n, c), now())


@query(
    "dangling_document",
    "f_concepts",
    sql=f"""WITH d AS (SELECT * FROM f_concepts WHERE note_id IS NULL AND mentions > 0 ORDER BY mentions DESC, last_seen DESC, slug LIMIT 100)
SELECT concat({_MAP.format('index')}, {_LF}, '# Unresolved concepts', {_LF}, {_LF}, 'Concepts the notes link to that have no Electron of their own. They get one at 2 mention(s).', {_LF}, {_LF}, '| Concept | Mentions | First seen | Last seen |', {_LF}, '| --- | --- | --- | --- |', {_LF},
  string_agg(concat('| [[', slug, ']] | ', mentions, ' | ', strftime(first_seen, '%Y-%m-%d'), ' | ', strftime(last_seen, '%Y-%m-%d'), ' |', {_LF}), '' ORDER BY mentions DESC, last_seen DESC, slug)) AS document FROM d""",
)
def dangling_document(c):
    return B.dangling_document(c, now())


_SECTION = "CASE WHEN count(*) FILTER (note_type = '{0}') > 0 THEN concat('## {1}', chr(10), string_agg(concat('- [[', slug, ']] — ', title), chr(10) ORDER BY k) FILTER (note_type = '{0}'), chr(10), chr(10)) ELSE '' END"


@query(
    "daily_documents",
    "f_notes",
    sql=f"""WITH d AS (SELECT *, strftime(created_at, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, id) AS k FROM f_notes),
x AS (SELECT day, concat({_SECTION.format('atom', 'Notes added today')}, {_SECTION.format('electron', 'Concepts that earned a note')}) AS t FROM d WHERE k <= 200 GROUP BY day)
SELECT day, concat({_MAP.format('daily')}, {_LF}, '# ', day, {_LF}, {_LF}, CASE WHEN right(day, 1) = '5' THEN concat('## Digest', {_LF}, 'On ', day, {_LF}, {_LF}) ELSE '' END, t) AS document FROM x""",
)
def daily_documents(n):
    """Days that end in 5 have a digest."""
    days = n.select(F.to_date("created_at").alias("date")).distinct()
    digests = days.select("date", F.when(F.dayofmonth("date") % 10 == 5, F.concat(F.lit("On "), F.col("date").cast("string"))).otherwise("").alias("overview"))
    return B.daily_documents(n, digests, now())
