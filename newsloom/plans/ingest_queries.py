"""De-duplication, stories and source health over the domain views."""

from pyspark.sql import functions as F

from newsloom.functions.simhash import article_simhash
from newsloom.operators import ingest as I
from newsloom.operators.tables import checkpointed
from newsloom.plans.core import query
from newsloom.plans.fixtures import AS_OF
from newsloom.plans.text_queries import SIMHASH, TOKENS



def now():
    return F.lit(AS_OF).cast("timestamp_ntz")


#: The canonical form of the article view's urls.
URL = r"CASE WHEN url LIKE '%utm_source=rss&b=1' THEN replace(url, 'utm_source=rss&', '') ELSE regexp_replace(url, '/$|#top$', '') END"


def hashed(a):
    return a.withColumn("simhash", article_simhash(F.col("title"), F.col("content_md")))


PAIRS = f"""tk AS (SELECT id, list_distinct({TOKENS}) AS t FROM f_articles),
ex AS (SELECT id, unnest(t) AS w FROM tk),
pc AS (SELECT x.id AS later, y.id AS earlier, count(*) AS n FROM ex x JOIN ex y ON x.w = y.w AND x.id > y.id GROUP BY ALL HAVING count(*) >= 4),
pp AS (SELECT later, earlier, n::DOUBLE / (len(a.t) + len(b.t) - n) AS score, list_filter(a.t, lambda x: regexp_matches(x, '[0-9]')) AS va, list_filter(b.t, lambda x: regexp_matches(x, '[0-9]')) AS vb
  FROM pc JOIN tk a ON a.id = later JOIN tk b ON b.id = earlier),
pairs AS (SELECT later, earlier, score FROM pp WHERE score >= 0.55 AND (len(va) = 0 OR len(vb) = 0 OR list_has_any(va, vb)))"""
_SIM = SIMHASH.strip().removeprefix("WITH ")
NEAR = f"{_SIM}, near AS (SELECT x.id AS later, y.id AS earlier, CAST(bit_count(xor(x.h, y.h)) AS INTEGER) AS distance FROM sim x JOIN sim y ON x.id > y.id WHERE x.h <> 0 AND y.h <> 0 AND bit_count(xor(x.h, y.h)) <= 3)"
STORIES = f"""WITH RECURSIVE {PAIRS}, {NEAR},
title_parent AS (SELECT later AS id, arg_min(earlier, struct_pack(s := -score, e := earlier)) AS parent FROM pairs GROUP BY later),
parents AS (SELECT id, parent FROM title_parent UNION ALL SELECT later, min(earlier) FROM near WHERE later NOT IN (SELECT id FROM title_parent) GROUP BY later),
climb AS (SELECT id, parent AS root, 1 AS d FROM parents UNION ALL SELECT c.id, p.parent, c.d + 1 FROM climb c JOIN parents p ON p.id = c.root),
roots AS (SELECT id, arg_max(root, d) AS root FROM climb GROUP BY id),
stories AS (SELECT a.id, coalesce(r.root, CASE WHEN a.id IN (SELECT root FROM roots) THEN a.id ELSE 0 END) AS story_id FROM f_articles a LEFT JOIN roots r ON r.id = a.id)
"""


@query("headline_classes", "f_articles", sql=f"WITH tk AS (SELECT id, list_sort(list_distinct({TOKENS})) AS t FROM f_articles) SELECT id, min(id) OVER (PARTITION BY t) AS class FROM tk WHERE len(t) >= 4")
def headline_classes(a):
    return I.headline_classes(a).select("id", "class")


_FIRST = "fc AS (SELECT min(id) AS f FROM tk GROUP BY list_sort(t))"


@query("story_pairs", "f_articles", sql=f"WITH {PAIRS}, {_FIRST} SELECT later, earlier, round(score, 6) AS score FROM pairs WHERE later IN (SELECT f FROM fc) AND earlier IN (SELECT f FROM fc)")
def story_pairs(a):
    return I.story_pairs(a).withColumn("score", F.round("score", 6))


@query("simhash_classes", "f_articles", sql=SIMHASH + "SELECT id, min(id) OVER (PARTITION BY h) AS class FROM sim WHERE h <> 0")
def simhash_classes(a):
    own = checkpointed(hashed(a).select("id", "simhash"))
    return own.join(I.simhash_classes(own), "simhash").select("id", F.col("first").alias("class"))


@query("near_duplicates", "f_articles", sql=f"WITH {NEAR}, fh AS (SELECT min(id) AS f FROM sim WHERE h <> 0 GROUP BY h) SELECT later, earlier, distance FROM near WHERE later IN (SELECT f FROM fh) AND earlier IN (SELECT f FROM fh)")
def near_duplicates(a):
    return I.near_duplicates(hashed(a).select("id", "simhash"))


@query("assign_stories", "f_articles", sql=STORIES + "SELECT id, story_id FROM stories")
def assign_stories(a):
    return I.assign_stories(hashed(a))


@query(
    "story_coverage",
    "f_articles",
    "f_sources",
    sql=STORIES
    + "SELECT s.story_id, count(*) AS story_size, count(DISTINCT f.name) AS outlets, array_to_string(list_sort(list(DISTINCT f.name)), ',') AS sources FROM stories s JOIN f_articles a ON a.id = s.id JOIN f_sources f ON f.id = a.source_id WHERE s.story_id <> 0 GROUP BY s.story_id HAVING count(*) >= 2",
)
def story_coverage(a, sources):
    named = a.join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id").select("id", "source_name")
    return I.story_coverage(I.assign_stories(hashed(a)).join(named, "id"))


@query("story_members", "f_articles", sql=STORIES + "SELECT story_id, id FROM stories WHERE story_id <> 0")
def story_members(a):
    stories = I.assign_stories(hashed(a))
    return I.story_members(stories, stories.where("story_id <> 0 AND story_id = id")).select("story_id", "id")


@query("drop_unusable", "f_articles", sql=f"SELECT id, {URL} AS url FROM f_articles")
def drop_unusable(a):
    return I.drop_unusable(a).select("id", "url")


@query("drop_stale", "f_articles", sql=f"SELECT id FROM f_articles WHERE published IS NULL OR published >= timestamp '{AS_OF}' - interval 14 day")
def drop_stale(a):
    return I.drop_stale(a, now(), 14).select("id")


@query("dedup_by_url", "f_articles", "pages", sql=f"SELECT min(id) AS id, u AS url FROM (SELECT id, regexp_replace({URL}, '/a/.*$', '') AS u FROM f_articles) WHERE u NOT IN (SELECT url FROM pages) GROUP BY u")
def dedup_by_url(a, pages):
    items = I.drop_unusable(a).select("id", F.regexp_replace("url", "/a/.*$", "").alias("url"))
    return I.dedup_by_url(items, pages)


@query(
    "ingest_summary",
    "f_articles",
    "f_fetch_log",
    sql=STORIES
    + f""", o AS (SELECT CASE WHEN a.published < timestamp '{AS_OF}' - interval 14 day OR a.id % 6 = 0 THEN 'skipped' WHEN s.story_id NOT IN (0, a.id) THEN 'grouped' WHEN a.id % 11 = 0 THEN 'updated' ELSE 'new' END AS outcome FROM f_articles a JOIN stories s ON s.id = a.id),
l AS (SELECT arg_max(outcome, struct_pack(t := cycle_ts, i := id)) AS outcome FROM f_fetch_log GROUP BY source_id)
SELECT count_if(outcome = 'new')::BIGINT AS new, count_if(outcome = 'updated')::BIGINT AS updated, count_if(outcome = 'grouped')::BIGINT AS grouped, count_if(outcome = 'skipped')::BIGINT AS skipped,
  (SELECT count(*) FROM l WHERE outcome <> 'failed') AS sources_fetched, (SELECT count(*) FROM l WHERE outcome = 'failed') AS sources_failed FROM o""",
)
def ingest_summary(a, log):
    """A sixth of the urls and an eleventh of the guids are known; a source counts by its last cycle."""
    known = I.drop_unusable(a.where("id % 6 = 0")).select("url")
    outcomes = I.ingest_outcomes(a, known, I.assign_stories(hashed(a)), now(), 14, a.where("id % 11 = 0").select("source_id", "guid"))
    cycles = log.groupBy("source_id").agg(F.max_by("outcome", F.struct("cycle_ts", "id")).alias("outcome"))
    return I.ingest_summary(outcomes, cycles)


_LOG = """WITH o AS (SELECT *, CASE WHEN outcome IS DISTINCT FROM lag(outcome) OVER w THEN 1 ELSE 0 END AS c FROM f_fetch_log WINDOW w AS (PARTITION BY source_id ORDER BY cycle_ts, id)),
r AS (SELECT *, sum(c) OVER (PARTITION BY source_id ORDER BY cycle_ts, id) AS run FROM o),
s AS (SELECT *, row_number() OVER (PARTITION BY source_id, run ORDER BY cycle_ts, id) AS streak FROM r),
l AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY cycle_ts DESC, id DESC) AS last FROM s),
health AS (SELECT source_id, CAST(CASE outcome WHEN 'failed' THEN streak ELSE 0 END AS INTEGER) AS consecutive_failures, CAST(CASE outcome WHEN 'empty' THEN streak ELSE 0 END AS INTEGER) AS empty_cycles,
  (SELECT max(cycle_ts) FROM s x WHERE x.source_id = l.source_id AND x.outcome = 'ok') AS last_ok,
  CASE WHEN outcome = 'failed' THEN message WHEN outcome = 'empty' AND streak >= 3 THEN concat('no items in ', streak, ' fetches') ELSE '' END AS last_error FROM l WHERE last = 1) """


@query("source_health", "f_fetch_log", sql=_LOG + "SELECT * FROM health")
def source_health(log):
    return I.source_health(log)


@query("health_warnings", "f_fetch_log", sql=_LOG + "SELECT source_id, cycle_ts, outcome FROM s WHERE outcome <> 'ok' AND streak = 3")
def health_warnings(log):
    return I.health_warnings(log)


@query("unhealthy_sources", "f_sources", "f_fetch_log", sql=_LOG + "SELECT f.id, f.name FROM f_sources f JOIN health h ON h.source_id = f.id WHERE enabled AND NOT hidden AND (consecutive_failures >= 1 OR empty_cycles >= 1)")
def unhealthy_sources(sources, log):
    return I.unhealthy_sources(sources, I.source_health(log), 1).select("id", "name")
