"""Article lists and state over the domain views."""

from pyspark.sql import functions as F

from newsloom.operators import articles as A
from newsloom.operators import pages as P
from newsloom.operators.ingest import assign_stories
from newsloom.operators.tables import apply_changes, last_by, upsert
from newsloom.plans.core import query
from newsloom.plans.fixtures import AS_OF
from newsloom.plans.ingest_queries import now, STORIES, hashed

#: Articles with their stories.
ART = STORIES + ", art AS (SELECT a.*, s.story_id FROM f_articles a JOIN stories s ON s.id = a.id) "
ANCHOR = "(story_id = 0 OR story_id = id)"
ORDER = "published DESC NULLS LAST, fetched_at DESC, id"
TIME = f"timestamp '{AS_OF}'"


def storied(a):
    return a.join(assign_stories(hashed(a)), "id")


def _listing(name, where, views=("f_articles", "f_sources"), **options):
    sql = ART + f"SELECT a.id, a.story_id, f.name AS source_name FROM art a JOIN f_sources f ON f.id = a.source_id WHERE {where}"
    if "all_copies" in options:
        sql = f"SELECT a.id, f.name AS source_name FROM f_articles a JOIN f_sources f ON f.id = a.source_id WHERE {where}"
    columns = ("id", "source_name") if "all_copies" in options else ("id", "story_id", "source_name")

    @query(name, *views, sql=sql)
    def listing(a, s):
        own = a if "all_copies" in options else storied(a)
        return A.list_articles(own, s, limit=None, **options).select(*columns)


_A = "(a.story_id = 0 OR a.story_id = a.id)"
_listing("list_articles", _A)
_listing("list_by_status", f"{_A} AND a.status = 'read'", status="read")
_listing("list_unarchived", "a.status IN ('unread', 'read')", unarchived=True, all_copies=True)
_listing("list_starred", "a.starred", starred=True, all_copies=True)
_listing("list_by_category", "a.category = 'tools'", category="tools", all_copies=True)
_listing("list_by_source", "a.source_id = 3", source_id=3, all_copies=True)
_listing("list_by_group", "f.group_name = 'labs'", group="labs", all_copies=True)
_listing("list_importance_min", "a.importance >= 2", least_importance=2, all_copies=True)
_listing("list_importance_exact", "a.importance = 3", importance=3, all_copies=True)
_listing("list_unclassified_flag", f"{_A} AND NOT a.classified", unclassified=True)
_listing("list_summarized", "a.summary <> ''", summarised=True, all_copies=True)
_listing("list_title_like", "(a.title ILIKE '%tion%' OR a.author ILIKE '%tion%')", like="tion", all_copies=True)
_listing("list_all_copies", "true", all_copies=True)


@query("list_page", "f_articles", "f_sources", sql=f"SELECT id FROM (SELECT id FROM f_articles ORDER BY {ORDER} LIMIT 200 OFFSET 100)")
def list_page(a, s):
    return A.list_articles(a, s, all_copies=True, limit=200, offset=100).select("id")


@query("lookup_articles", "f_articles", sql="SELECT id, 1000000 - id AS pos FROM f_articles WHERE starred")
def lookup_articles(a):
    return A.lookup_articles(a, a.where("starred").select("id", (1000000 - F.col("id")).alias("pos"))).select("id", "pos")


@query("count_by_status", "f_articles", sql="SELECT status, count(*) AS n FROM f_articles GROUP BY status")
def count_by_status(a):
    return a.groupBy("status").agg(F.count("*").alias("n"))


_QUEUE = f"status <> 'archived' AND NOT classified AND {ANCHOR} AND fetched_at >= {TIME} - interval 14 day AND (published IS NULL OR published >= {TIME} - interval 14 day)"


@query("unclassified_queue", "f_articles", sql=ART + f"SELECT id FROM (SELECT id FROM art WHERE {_QUEUE} ORDER BY {ORDER} LIMIT 100)")
def unclassified_queue(a):
    return A.unclassified_queue(storied(a), now()).select("id")


@query("count_unclassified", "f_articles", sql=ART + f"SELECT count(*) AS n FROM art WHERE status <> 'archived' AND NOT classified AND {ANCHOR}")
def count_unclassified(a):
    return storied(a).where((F.col("status") != "archived") & ~F.col("classified") & A.is_anchor()).agg(F.count("*").alias("n"))


@query("recent_articles", "f_articles", sql=f"SELECT id FROM (SELECT id FROM f_articles WHERE status <> 'archived' AND fetched_at >= {TIME} - interval 7 day ORDER BY {ORDER} LIMIT 500)")
def recent_articles(a):
    return A.recent_articles(a, now()).select("id")



@query("kb_candidates", "f_articles", "f_notes", sql=ART + f"SELECT id FROM (SELECT id FROM art WHERE classified AND importance >= 2 AND status <> 'archived' AND fetched_at >= {TIME} - interval 30 day AND {ANCHOR} AND id NOT IN (SELECT id FROM f_notes WHERE category = 'tools') ORDER BY importance DESC, {ORDER} LIMIT 200)")
def kb_candidates(a, n):
    return A.kb_candidates(storied(a), n.where("category = 'tools'"), now()).select("id")


@query("inbox", "f_articles", "f_notes", sql=f"SELECT id FROM (SELECT id FROM f_articles WHERE status <> 'archived' AND id NOT IN (SELECT id FROM f_notes) ORDER BY {ORDER} LIMIT 100)")
def inbox(a, n):
    return A.inbox(a, n).select("id")


@query("stale_notes", "f_articles", "f_notes", sql="SELECT a.id FROM f_articles a JOIN f_notes n ON n.id = a.id WHERE a.fetched_at >= n.created_at + (a.id % 3 - 1) * interval 1 hour")
def stale_notes(a, n):
    own = a.withColumn("updated_at", F.col("fetched_at"))
    notes = n.join(a.select("id"), "id").select("id", (F.col("created_at") + F.expr("(id % 3 - 1) * interval 1 hour")).alias("updated_at"))
    return A.stale_notes(own, notes.select("id", F.col("id").alias("note_id")), notes).select("id")


@query("pending_extraction", "f_articles", sql=ART + f"SELECT id FROM (SELECT id FROM art WHERE NOT extracted AND len(content_md) < 200 AND url <> '' AND {ANCHOR} ORDER BY importance DESC, fetched_at DESC, id LIMIT 20)")
def pending_extraction(a):
    return A.pending_extraction(storied(a)).select("id")


@query("extract_pending", "f_articles", "pages", sql="SELECT a.id, a.extracted OR (len(a.content_md) < 200 AND p.page_id IS NOT NULL) AS extracted, NOT a.extracted AND len(a.content_md) < 200 AND p.page_id IS NOT NULL AS filled FROM f_articles a LEFT JOIN pages p ON p.page_id = a.id AND p.page_id % 5 <> 0")
def extract_pending(a, p):
    """Pages of a fifth of the articles hold a script alone and can't be read."""
    html = F.when(F.col("page_id") % 5 == 0, F.lit("<html><script>var a = 1;</script></html>")).otherwise(F.replace("html", F.lit("<article>"), F.lit("<article><p>" + "word " * 60 + "</p>")))
    landed = p.select(F.concat(F.lit("p"), F.col("page_id")).alias("url"), html.alias("html"))
    own = a.withColumn("url", F.concat(F.lit("p"), F.col("id"))).withColumn("story_id", F.lit(0))
    after, _ = P.extract_landed(own, landed)
    before = own.select("id", F.col("content_md").alias("_old"))
    return after.join(before, "id").select("id", "extracted", (F.length("content_md") >= 200).__and__(F.length("_old") < 200).alias("filled"))


_CHANGES = "c AS (SELECT id, CASE id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'archived' ELSE 'starred' END AS status FROM f_articles WHERE starred)"


@query("apply_status_changes", "f_articles", sql=f"WITH {_CHANGES} SELECT a.id, coalesce(c.status, a.status) AS status FROM f_articles a LEFT JOIN c ON c.id = a.id AND c.status IN ('unread', 'read', 'archived')")
def apply_status_changes(a):
    changes = a.where("starred").select("id", F.expr("CASE id % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'archived' ELSE 'starred' END").alias("status"), F.lit("user").alias("actor"), F.col("fetched_at").alias("at"))
    return A.apply_status_changes(a, changes)[0].select("id", "status")


@query("apply_star_changes", "f_articles", sql="SELECT id, CASE WHEN classified THEN NOT starred ELSE starred END AS starred, importance FROM f_articles")
def apply_star_changes(a):
    return apply_changes(a, a.where("classified").select("id", (~F.col("starred")).alias("starred"))).select("id", "starred", "importance")


@query("apply_classification", "f_articles", sql="SELECT id, CASE WHEN classified THEN category ELSE 'general' END AS category, CAST(CASE WHEN classified THEN importance ELSE 1 END AS INTEGER) AS importance, true AS classified FROM f_articles")
def apply_classification(a):
    return apply_changes(a, a.where("NOT classified").select("id", F.lit("general").alias("category"), F.lit(1).alias("importance"), F.lit(True).alias("classified"))).select("id", "category", "importance", "classified")


@query(
    "replay_events",
    "f_article_events",
    sql="""SELECT article_id, arg_max(event, struct_pack(t := created_at, i := id)) FILTER (event IN ('unread', 'read', 'archived')) AS status,
  arg_max(event, struct_pack(t := created_at, i := id)) FILTER (event IN ('starred', 'unstarred')) IS NOT DISTINCT FROM 'starred' AS starred FROM f_article_events GROUP BY article_id""",
)
def replay_events(e):
    return A.replay_events(e)


@query(
    "upsert_articles",
    "f_articles",
    sql=f"""SELECT source_id, guid, CASE WHEN starred THEN concat(title, '!') ELSE title END AS title, status, CASE WHEN classified THEN fetched_at ELSE {TIME} END AS fetched_at,
  CASE WHEN classified AND NOT starred THEN fetched_at ELSE {TIME} END AS updated_at, NOT classified AS created FROM f_articles WHERE classified OR starred OR extracted""",
)
def upsert_articles(a):
    stored = a.where("classified").select("source_id", "guid", "title", "status", "fetched_at", F.col("fetched_at").alias("updated_at"))
    incoming = a.where("starred OR (NOT classified AND extracted)").select("source_id", "guid", F.when(F.col("starred"), F.concat("title", F.lit("!"))).otherwise(F.col("title")).alias("title"), F.when(F.col("classified"), "unread").otherwise(F.col("status")).alias("status"))
    return P.upsert_articles(stored, incoming, now())


@query("enabled_sources", "f_sources", sql="SELECT id, name, group_name FROM f_sources WHERE enabled AND NOT hidden")
def enabled_sources(s):
    return s.where("enabled AND NOT hidden").orderBy("group_name", "name").select("id", "name", "group_name")


@query("list_sources", "f_sources", "f_articles", sql="SELECT name, group_name, CASE WHEN type = 'arxiv' THEN NOT enabled ELSE enabled END AS enabled, false AS created FROM f_sources UNION ALL SELECT concat('new-', category), 'general', true, true FROM (SELECT DISTINCT category FROM f_articles) WHERE category <> ''")
def list_sources(s, a):
    stored = s.select("name", "group_name", "enabled")
    created = a.where("category <> ''").select(F.concat(F.lit("new-"), F.col("category")).alias("name"), F.lit("general").alias("group_name"), F.lit(True).alias("enabled")).distinct()
    changed = s.where("type = 'arxiv'").select("name", "group_name", (~F.col("enabled")).alias("enabled"))
    return upsert(stored, changed.unionByName(created), ["name"])


@query("list_digests", "f_articles", sql="SELECT CAST(fetched_at AS DATE) AS date, arg_max(title, id) AS overview FROM f_articles GROUP BY 1")
def list_digests(a):
    saved = a.select(F.to_date("fetched_at").alias("date"), F.col("title").alias("overview"), "id")
    return last_by(saved, ["date"], F.col("id")).select("date", "overview").orderBy(F.desc("date"))


@query("note_of_article", "f_articles", "f_notes", sql="SELECT a.id, n.slug FROM f_articles a LEFT JOIN f_notes n ON n.id = a.id AND n.note_type = 'atom'")
def note_of_article(a, n):
    return a.select("id").join(n.where("note_type = 'atom'").select("id", "slug"), "id", "left")


@query(
    "ingest_pages",
    "pages",
    "f_articles",
    "f_sources",
    sql=r"""WITH f AS (SELECT url, arg_min(html, page_id) AS html, min(page_id) AS page_id FROM pages WHERE url NOT IN (SELECT url FROM f_articles) GROUP BY url)
SELECT (SELECT max(id) + 1 FROM f_sources) AS source_id, sha256(url) AS guid, url, trim(regexp_replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1), '&amp;', '&'), '\s+', ' ', 'g')) AS title, CASE WHEN page_id % 3 = 0 THEN concat('Ada ', page_id) ELSE '' END AS author FROM f""".replace("\\\\", "\\"),
)
def ingest_pages(p, a, s):
    """A third of the pages say who wrote them."""
    author = F.concat(F.lit('<head><meta name="Author" content=" Ada  '), "page_id", F.lit('">'))
    html = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<head>"), author)).otherwise(F.col("html"))
    return P.ingest_pages(p.withColumn("html", html), a, P.with_manual_source(s)).select("source_id", "guid", "url", "title", "author")


@query("manual_source", "f_sources", sql="SELECT id, name, hidden FROM f_sources UNION ALL SELECT max(id) + 1, 'Manual', true FROM f_sources")
def manual_source(s):
    """It is added once."""
    return P.with_manual_source(P.with_manual_source(s)).select("id", "name", "hidden")


@query("note_documents", "f_notes", sql="SELECT id, concat(CASE note_type WHEN 'electron' THEN '01-Electrons/' ELSE '02-Atoms/' END, slug, '.md') AS path FROM f_notes")
def note_documents(n):
    folder = F.when(F.col("note_type") == "inbox", "00-Inbox/").when(F.col("note_type") == "electron", "01-Electrons/").when(F.col("note_type") == "atom", "02-Atoms/").when(F.col("note_type") == "molecule", "03-Molecules/").otherwise("")
    return n.select("id", F.concat(folder, F.col("slug"), F.lit(".md")).alias("path"))
