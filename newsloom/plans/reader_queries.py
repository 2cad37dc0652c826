"""Payload files landed from the tables and read back by the readers, and the stream that puts landed articles into stories."""

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.plans.core import ORACLES, QUERIES, query
from newsloom.plans.fixtures import oracle, view
from newsloom.plans.ingest_queries import STORIES
from newsloom.sources import readers as S
from newsloom.streaming import streams as Z
from newsloom.streaming.stories import read_stories, story_batch

#: Payloads of a page of search results, or of a file of mail.
PAGE = 50


def _folder(spark):
    return Z.work_folder(spark)


def _escaped(c):
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(name))
    return c


def _element(name, c):
    return F.concat(F.lit(f"<{name}>"), _escaped(F.coalesce(c, F.lit(""))), F.lit(f"</{name}>"))


def _pages(rows, value):
    """One file for each page of rows (_id, v), of what ``value`` makes of their list ``l``."""
    folder = _folder(rows.sparkSession)
    pages = rows.groupBy(F.floor(F.col("_id") / PAGE).alias("_page")).agg(F.sort_array(F.collect_list(F.struct("_id", "v"))).alias("_l")).select(F.transform("_l", lambda x: x["v"]).alias("l"))
    pages.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    return folder


def _feed(a):
    """Articles as feed items; every fourth has a link and no guid."""
    guid = F.when(F.col("id") % 4 == 0, F.lit("")).otherwise(F.col("guid"))
    parts = [_element("guid", guid), _element("link", F.col("url")), _element("title", F.col("title")), _element("author", F.col("author")), _element("pubDate", F.date_format("published", "d MMM yyyy HH:mm:ss 'GMT'")), _element("description", F.col("summary"))]
    item = F.concat(F.lit("<item>"), *parts, F.lit("</item>"))
    return _pages(a.select(F.col("id").alias("_id"), item.alias("v")), F.concat(F.lit('<rss version="2.0"><channel>'), F.array_join("l", "\n"), F.lit("</channel></rss>")))


def _hits(a):
    url = F.when(F.col("id") % 6 == 0, F.lit("")).otherwise(F.col("url"))
    hit = F.struct(F.col("id").cast("string").alias("objectID"), "title", url.alias("url"), "author", F.col("summary").alias("story_text"), F.date_format("published", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))
    return _pages(a.select(F.col("id").alias("_id"), hit.alias("v")), F.to_json(F.struct(F.col("l").alias("hits"))))


def _mail(a):
    """Articles as mail messages whose text is eight parts deep; every third has html beside it."""
    data = lambda c: F.struct(F.translate(F.base64(F.encode(c, "UTF-8")), "+/=\r\n", "-_").alias("data"))
    plain = F.struct(F.lit("text/plain").alias("mimeType"), data(F.col("summary")).alias("body"))
    page = F.struct(F.lit("text/html").alias("mimeType"), data(F.when(F.col("id") % 3 == 0, F.concat(F.lit("<p>"), F.col("guid"), F.lit("</p>"))).otherwise("")).alias("body"))
    part = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(plain, page).alias("parts"))
    for _ in range(7):
        part = F.struct(F.lit("multipart/mixed").alias("mimeType"), F.array(part).alias("parts"))
    header = lambda name, c: F.struct(F.lit(name).alias("name"), c.alias("value"))
    headers = F.array(header("Subject", F.col("title")), header("From", F.col("author")), header("Date", F.date_format("fetched_at", "d MMM yyyy HH:mm:ss '+0000'")))
    payload = F.struct(headers.alias("headers"), F.lit("multipart/mixed").alias("mimeType"), part["parts"].alias("parts"))
    return _pages(a.select(F.col("id").alias("_id"), F.struct(F.col("guid").alias("id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("threadId"), payload.alias("payload")).alias("v")), F.to_json("l"))


_FEED = "coalesce(published, NULL) AS published FROM f_articles"
_COLUMNS = ("guid", "url", "title", "author", "published")


def _typed(items, *columns):
    return items.withColumn("published", F.col("published").cast("timestamp_ntz")).select(*columns)


@query("read_feed_items", "f_articles", sql=f"SELECT CASE WHEN id % 4 = 0 THEN url ELSE guid END AS guid, url, title, author, {_FEED}")
def read_feed_items(a):
    return _typed(S.read_feed_items(a.sparkSession, _feed(a)), *_COLUMNS)


@query("read_arxiv_items", "f_articles", sql=f"SELECT CASE WHEN id % 4 = 0 THEN url ELSE guid END AS guid, url, title, '' AS author, {_FEED}")
def read_arxiv_items(a):
    return _typed(S.read_arxiv_items(a.sparkSession, _feed(a)), *_COLUMNS)


@query("read_hn_items", "f_articles", sql=f"SELECT concat('hn-', id) AS guid, CASE WHEN id % 6 = 0 THEN concat('https://talk.example/', id) ELSE url END AS url, title, author, {_FEED} WHERE title <> ''")
def read_hn_items(a):
    return _typed(S.read_hn_items(a.sparkSession, _hits(a), "https://talk.example/"), *_COLUMNS)


@query("read_mail_items", "f_articles", sql="SELECT guid, concat('https://mail.example/t', id) AS url, title, author, CASE WHEN id % 3 = 0 THEN concat('<p>', guid, '</p>') ELSE '' END AS content_html, coalesce(summary, '') AS content_md, fetched_at AS published FROM f_articles WHERE fetched_at >= timestamp '2024-01-04 00:00:00'")
def read_mail_items(a):
    as_of = F.lit("2024-01-27 00:00:00").cast("timestamp")
    return _typed(S.read_mail_items(a.sparkSession, _mail(a), as_of, 23, "https://mail.example/"), "guid", "url", "title", "author", "content_html", "content_md", "published")


@query("read_items", "f_articles", sql="""SELECT source_id, count(*) AS items, '' AS unknown FROM (SELECT unnest([1, 2, 4]) AS source_id FROM f_articles UNION ALL SELECT 3 FROM f_articles WHERE title <> '') GROUP BY 1
UNION ALL SELECT 5, 0, 'fax'""")
def read_items(a):
    spark = a.sparkSession
    sources = [(1, "rss", _feed(a)), (2, "arxiv", _feed(a)), (3, "hackernews", _hits(a)), (4, "gmail", _mail(a.withColumn("fetched_at", F.current_timestamp()))), (5, "fax", "")]
    items, errors = S.read_items(spark, sources)
    counted = items.groupBy("source_id").agg(F.count("*").alias("items"), F.lit("").alias("unknown"))
    return counted.unionByName(errors.select("source_id", F.lit(0).cast("long").alias("items"), F.col("type").alias("unknown"))).select(F.col("source_id").cast("int").alias("source_id"), "items", "unknown")


def _notes(n):
    """Notes as markdown texts."""
    lists = lambda c, before, after: F.array_join(F.transform(c, lambda t: F.concat(F.lit(before), t, F.lit(after))), "")
    status = F.when(F.col("id") % 11 == 0, F.lit("status: generated\n")).otherwise("")
    return F.concat(F.lit("---\ntype: "), F.col("note_type"), F.lit("\n"), status, F.lit("tags:\n"), lists("tags", "  - ", "\n"), F.lit("---\n# "), F.col("slug"), F.lit("\n\n"), lists("wikilinks", "see [[", "|x]]\n"))


_NOTE = "slug AS title, array_to_string(tags, ',') AS tags, array_to_string(wikilinks, ',') AS wikilinks FROM f_notes"


@query("parse_note", "f_notes", sql=f"SELECT id, {_NOTE}")
def parse_note(n):
    own = n.withColumn("_t", _notes(n)).select("id", X.split_frontmatter(F.col("_t")).alias("f"))
    return own.select("id", X.parse_title(F.col("f.frontmatter"), F.col("f.body"), F.lit("x/y.md")).alias("title"), F.array_join(X.parse_tags(F.col("f.frontmatter")), ",").alias("tags"), F.array_join(X.parse_wikilinks(F.col("f.body")), ",").alias("wikilinks"))


@query("read_notes", "f_notes", sql=f"SELECT CASE WHEN id % 11 = 0 THEN 'skipped' ELSE 'new' END AS outcome, note_type, {_NOTE}")
def read_notes(n):
    spark, folder = n.sparkSession, _folder(n.sparkSession)
    n.select(_notes(n).alias("value")).write.option("maxRecordsPerFile", 1).text(folder)
    out = S.read_notes(spark, folder, spark.createDataFrame([], "path string, content_hash string, origin string"))
    return out.select("outcome", "note_type", "title", F.array_join("tags", ",").alias("tags"), F.array_join("wikilinks", ",").alias("wikilinks"))


@query("read_rules", "f_sources", sql="SELECT row_number() OVER (ORDER BY id) AS id, name, concat(name, '\\.example') AS query, CASE WHEN hidden THEN 'keep' ELSE 'archive' END AS action, enabled FROM f_sources")
def read_rules(s):
    spark, folder = s.sparkSession, _folder(s.sparkSession)
    action = F.struct(F.when(F.col("hidden"), "keep").otherwise("archive").alias("type"), F.lit("").alias("value"))
    S.write_rules(s.select("id", "name", F.concat("name", F.lit("\\.example")).alias("query"), F.array(action).alias("actions"), "enabled"), folder)
    return S.read_rules(spark, folder).select(F.col("id").cast("long").alias("id"), "name", "query", F.col("actions")[0]["type"].alias("action"), "enabled")


@query("parse_model_json", "f_articles", sql="SELECT id AS reply, CASE WHEN id % 10 = 3 THEN 0 ELSE id END AS item, CASE WHEN id % 10 = 3 THEN '' ELSE category END AS category, id % 10 = 3 AS error FROM f_articles")
def parse_model_json(a):
    """Replies in fences, with a trailing comma, beside an item of id 0, or without a list."""
    item = F.to_json(F.struct("id", "category", "tags", "importance"))
    body = F.when(F.col("id") % 3 == 0, F.concat(F.lit("["), item, F.lit(",\n]"))).when(F.col("id") % 3 == 1, F.concat(F.lit("Sure:\n```json\n["), item, F.lit("]\n```"))).otherwise(F.concat(F.lit("["), item, F.lit(', {"id": 0}]')))
    out = S.parse_model_json(a.select(F.col("id").alias("reply"), F.when(F.col("id") % 10 == 3, F.lit("I can't")).otherwise(body).alias("text")))
    return out.select("reply", F.coalesce("item.id", F.lit(0)).alias("item"), F.coalesce("item.category", F.lit("")).alias("category"), "error")


#: Articles come in three batches by id, 37 minutes after each other; those of earlier batches are joined for 30 days.
_BATCHES = """bt AS (SELECT id, (id - 1) * 3 // (SELECT max(id) FROM f_articles) AS b FROM f_articles), be AS (SELECT b, max(id) AS last FROM bt GROUP BY b),
met AS (SELECT l.id AS later, e.id AS earlier FROM bt l JOIN be ON be.b = l.b JOIN bt e ON e.id < l.id AND (e.b = l.b OR e.id * 37 >= be.last * 37 - 43200))"""


def stream_stories(spark, sf_dir):
    landed, work = _folder(spark), _folder(spark)
    own = view(spark, sf_dir, "f_articles").select("id", "title", "content_md", (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("id") * 37)).alias("fetched_at"))
    last = own.select(F.max("id")).first()[0]
    for batch in range(3):
        own.where(F.floor((F.col("id") - 1) * 3 / last) == batch).write.mode("append").parquet(landed)
        # all that has landed since is one batch; the stream stops after it and goes on
        Z.landing(spark, landed).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{work}/state").foreachBatch(story_batch(f"{work}/stories")).start().awaitTermination()
    return read_stories(spark, f"{work}/stories")


QUERIES["stream_stories"] = stream_stories
ORACLES["stream_stories"] = oracle(
    STORIES.replace("title_parent AS (", f"{_BATCHES}, title_parent AS (", 1).replace("FROM pairs GROUP BY later", "FROM pairs SEMI JOIN met USING (later, earlier) GROUP BY later").replace("FROM near WHERE", "FROM near SEMI JOIN met USING (later, earlier) WHERE") + "SELECT id, story_id FROM stories"
)
