"""Readers of landed payload files: feeds, search results, mail, notes and rule sets, as typed item frames.

Every reader gives ``ITEM``'s columns. Payloads that don't parse give no row; nothing is fetched from a network.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.markdown import html_to_markdown
from newsloom.functions.text import parse_tags, parse_title, parse_wikilinks, split_frontmatter, trimmed

ITEM = "guid string, url string, title string, author string, content_html string, content_md string, published timestamp"
_FEED = T.StructType([T.StructField(n, T.StringType()) for n in ("guid", "id", "title", "description", "summary", "content", "content:encoded", "author", "dc:creator", "pubDate", "published", "updated")] + [T.StructField("link", T.ArrayType(T.StringType()))])


def _text(*columns: str) -> Column:
    """The first of the columns that isn't blank, else empty."""
    return F.coalesce(*[F.nullif(trimmed(F.col(f"`{c}`")), F.lit("")) for c in columns], F.lit(""))


def feed_time(text: Column) -> Column:
    """Time of a feed entry: RFC 822 or RFC 3339; else null."""
    bare = F.regexp_replace(trimmed(text), r"^[A-Za-z]{3},\s*", "")
    zoned = F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(*[F.try_to_timestamp(zoned, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z")], F.try_to_timestamp(trimmed(text)))


def _entries(spark: SparkSession, path: str, tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).option("valueTag", "_VALUE").option("ignoreNamespace", False).schema(_FEED).load(path)


def _link(raw: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(raw, trimmed), lambda x: x != ""), F.lit(0)), F.lit(""))


def _items(entries: DataFrame, guid: Column, url: Column, author: Column) -> DataFrame:
    own = entries.select(
        guid.alias("guid"), url.alias("url"), _text("title").alias("title"), author.alias("author"),
        _text("content:encoded", "content", "description", "summary").alias("content_html"), F.coalesce(feed_time(F.col("pubDate")), feed_time(F.col("published")), feed_time(F.col("updated"))).alias("published"),
    )
    return html_to_markdown(own.withColumn("html", F.col("content_html"))).withColumnRenamed("markdown", "content_md").select("guid", "url", "title", "author", "content_html", "content_md", "published")


def read_feed_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """Items of RSS (``item``) or Atom (``entry``) files; those without link and guid are left out."""
    e = _entries(spark, path, tag).withColumn("_link", _link(F.col("link")))
    guid = F.coalesce(F.nullif(_text("guid", "id"), F.lit("")), F.nullif("_link", F.lit("")), _text("title"))
    url = F.coalesce(F.nullif("_link", F.lit("")), _text("guid", "id"))
    return _items(e, guid, url, _text("author", "dc:creator")).where("url <> ''")


def read_arxiv_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """As feeds, but the link is the url as it is, there is no author, and an entry without guid and link is left out."""
    e = _entries(spark, path, tag).withColumn("_link", _link(F.col("link")))
    guid = F.coalesce(F.nullif(_text("guid", "id"), F.lit("")), F.col("_link"))
    return _items(e, guid, F.col("_link"), F.lit("")).where("guid <> ''")


def read_hn_items(spark: SparkSession, path: str, page: str = "https://news.ycombinator.com/item?id=") -> DataFrame:
    """Items of search-result JSON ({hits: […]}); without a url the discussion page is it; link posts have no body."""
    hit = "struct<objectID:string,title:string,url:string,author:string,story_text:string,created_at:string>"
    hits = spark.read.schema(f"hits array<{hit}>").json(path, multiLine=True).select(F.explode("hits").alias("h")).select("h.*")
    own = hits.where(trimmed(F.coalesce("title", F.lit(""))) != "").select(
        F.concat(F.lit("hn-"), F.col("objectID")).alias("guid"), F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit(page), F.col("objectID"))).alias("url"), trimmed(F.col("title")).alias("title"),
        F.coalesce("author", F.lit("")).alias("author"), F.coalesce("story_text", F.lit("")).alias("content_html"), F.try_to_timestamp("created_at").alias("published"),
    )
    return html_to_markdown(own.withColumn("html", F.col("content_html"))).withColumnRenamed("markdown", "content_md").select("guid", "url", "title", "author", "content_html", "content_md", "published")


def read_mail_items(spark: SparkSession, path: str, as_of: Column | None = None, newer_than: int = 7, thread: str = "") -> DataFrame:
    """Items of mail-message JSON: the first plain and the first html part in depth-first order, however deep.

    An unreadable date is ``as_of`` (not given: now); messages older than ``newer_than`` days are left out.
    ``thread`` is the url before a thread's id. Parts are nested without end, so they are read as a tree by batches.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    raw = spark.read.schema("id string, threadId string, payload string").json(path, multiLine=True)
    found = raw.withColumn("_parts", _mail_parts("payload"))
    head = F.from_json("payload", "headers array<struct<name:string,value:string>>")["headers"]

    def body(kind: str) -> Column:
        data = F.translate(F.col(f"_parts.{kind}"), "-_", "+/")
        padded = F.rpad(data, (F.ceil(F.length(data) / 4) * 4).cast("int"), "=")
        return F.coalesce(F.decode(F.unbase64(padded), "UTF-8"), F.lit(""))

    header = lambda name: F.coalesce(F.get(F.filter(head, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"], F.lit(""))
    sent = F.coalesce(feed_time(F.regexp_replace(header("date"), r"\s*\([^)]*\)$", "")), as_of)
    own = found.select(
        F.col("id").alias("guid"), (F.concat(F.lit(thread), F.col("threadId")) if thread else F.lit("")).alias("url"), trimmed(header("subject")).alias("title"), header("from").alias("author"),
        body("html").alias("content_html"), body("plain").alias("content_md"), sent.alias("published"),
    )
    return own.where(F.col("published") >= as_of - F.make_dt_interval(F.lit(newer_than)))


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("plain", "html")]))
def _mail_parts(payloads: pd.Series) -> pd.DataFrame:
    """The encoded data of the first text/plain and text/html part with data, depth first."""
    rows = []
    for payload in payloads:
        found: dict[str, str] = {}
        todo = [json.loads(payload)] if payload else []
        while todo and len(found) < 2:
            part = todo.pop() or {}
            kind, data = str(part.get("mimeType") or ""), (part.get("body") or {}).get("data")
            for name in ("plain", "html"):
                if data and kind.startswith(f"text/{name}"):
                    found.setdefault(name, data)
            todo.extend(reversed(part.get("parts") or []))
        rows.append((found.get("plain"), found.get("html")))
    return pd.DataFrame(rows, columns=["plain", "html"], dtype=object)


READERS = {"rss": read_feed_items, "arxiv": read_arxiv_items, "hackernews": read_hn_items, "gmail": read_mail_items}


def read_items(spark: SparkSession, sources: list[tuple[int, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of sources (id, type, path): all readers' items with their source_id, and a row for each source of unknown type."""
    empty = spark.createDataFrame([], f"source_id long, {ITEM}")
    for source_id, kind, path in sources:
        if kind in READERS:
            empty = empty.unionByName(READERS[kind](spark, path).withColumn("source_id", F.lit(source_id).cast("long")))
    unknown = [(i, k) for i, k, _ in sources if k not in READERS]
    return empty, spark.createDataFrame(unknown, "source_id long, type string")


def read_notes(spark: SparkSession, path: str, known: DataFrame, marker: str = "<!-- generated -->") -> DataFrame:
    """Markdown files of a folder as notes with an outcome against ``known`` (path, content_hash, origin): new, updated or skipped.

    Files with the generated marker or ``status: generated`` are skipped, as are unchanged ones and notes that didn't come from a file.
    """
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    own = raw.withColumns({"_f": split_frontmatter(F.col("value")), "content_hash": F.sha2("value", 256)})
    joined = own.join(known.select("path", F.col("content_hash").alias("_hash"), "origin"), "path", "left")
    generated = F.contains("value", F.lit(marker)) | F.col("_f.frontmatter").rlike(r"(?m)^status:\s*generated\s*$")
    outcome = F.when(generated | (F.col("_hash") == F.col("content_hash")) | (F.col("origin") != "vault"), "skipped").when(F.col("_hash").isNull(), "new").otherwise("updated")
    declared = F.regexp_extract("_f.frontmatter", r"(?m)^type:\s*(\w+)", 1)
    folder = F.element_at(F.split("path", "/"), -2)
    by_folder = F.when(folder == "01-Electrons", "electron").when(folder == "02-Atoms", "atom").when(folder == "03-Molecules", "molecule").otherwise("inbox")
    kind = F.when(declared.isin("inbox", "electron", "atom", "molecule"), declared).otherwise(by_folder)
    return joined.select(
        "path", "content_hash", outcome.alias("outcome"), kind.alias("note_type"), parse_title(F.col("_f.frontmatter"), F.col("_f.body"), F.col("path")).alias("title"),
        parse_tags(F.col("_f.frontmatter")).alias("tags"), parse_wikilinks(F.col("_f.body")).alias("wikilinks"), F.col("value").alias("content"),
    )


_RULE = "struct<name:string,note:string,query:string,actions:array<struct<type:string,value:string>>,enabled:boolean>"


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a rule-set file, {version, rules: […]} or a bare array; ``enabled`` is true where it isn't said."""
    raw = spark.read.text(path, wholetext=True)
    rules = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{_RULE}>")).otherwise(F.from_json("value", f"struct<version:int,rules:array<{_RULE}>>")["rules"])
    return raw.select(F.posexplode(rules).alias("id", "r")).select((F.col("id") + 1).alias("id"), "r.name", "r.query", "r.actions", F.coalesce("r.enabled", F.lit(True)).alias("enabled"))


def write_rules(rules: DataFrame, path: str) -> None:
    """Writes rules as one rule-set document. Rules are a short list."""
    every = rules.agg(F.array_sort(F.collect_list(F.struct("id", "name", "query", "actions", "enabled"))).alias("rules"))
    own = every.select(F.to_json(F.struct(F.lit(1).alias("version"), F.transform("rules", lambda r: F.struct(r["name"].alias("name"), r["query"].alias("query"), r["actions"].alias("actions"), r["enabled"].alias("enabled"))).alias("rules"))).alias("value"))
    own.coalesce(1).write.text(path)


def parse_model_json(replies: DataFrame, schema: str = "array<struct<id:long,category:string,summary:string,tags:array<string>,importance:int>>") -> DataFrame:
    """(reply, place, item or error) of model replies (reply, text): the first list in the text, fences and a trailing comma forgiven; items of id 0 are left out."""
    body = F.regexp_extract("text", r"(?s)(\[.*\])", 1)
    repaired = F.regexp_replace(body, r",(\s*[\]}])", r"$1")
    items = F.coalesce(F.from_json(F.nullif(body, F.lit("")), schema, {"mode": "PERMISSIVE"}), F.from_json(F.nullif(repaired, F.lit("")), schema))
    own = replies.select("reply", items.isNull().alias("error"), F.posexplode_outer(items).alias("place", "item"))
    return own.where("error OR item.id <> 0").select("reply", "place", "item", "error")
