"""Column functions over articles, pages and documents."""

from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions.markdown import clean_markdown, extract_pages, html_to_markdown, strip_tags
from newsloom.functions.simhash import article_simhash, hamming
from newsloom.functions.url import normalize_url
from newsloom.plans.core import query

_STOP = ", ".join(f"'{w}'" for w in X.TITLE_STOPWORDS)
TOKENS = rf"list_transform(list_filter(regexp_extract_all(lower(title), '[a-z0-9][a-z0-9.\-]*'), lambda w: len(w) >= 2 and not list_contains([{_STOP}], w)), lambda w: regexp_replace(w, '[.\-]+$', ''))"
SLUG = r"coalesce(nullif(trim(substring(trim(regexp_replace(lower(trim({})), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80), '-'), ''), 'note')"
#: FNV-1a over the bytes of ASCII tokens, votes for each of 64 bits.
SIMHASH = r"""
WITH tok AS (SELECT id, unnest(list_filter(string_split_regex(lower(concat(trim(title), ' ', substring(content_md, 1, 400))), '[^a-z0-9]+'), lambda t: len(t) >= 3)) AS t FROM f_articles),
h AS (SELECT id, list_reduce(list_prepend(14695981039346656037::UBIGINT, list_transform(string_split(t, ''), lambda c: ascii(c)::UBIGINT)),
  lambda a, b: ((xor(a, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS h FROM tok),
v AS (SELECT id, i, sum(CASE WHEN (h >> i::UBIGINT) & 1 = 1 THEN 1 ELSE -1 END) AS s FROM h, range(0, 64) AS r(i) GROUP BY id, i),
sim AS (SELECT a.id, coalesce(sum(CASE WHEN v.s > 0 THEN pow(2, v.i)::HUGEINT ELSE 0 END), 0)::UBIGINT AS h FROM f_articles a LEFT JOIN v ON v.id = a.id GROUP BY a.id)
"""


@query("simhash_tokens", "f_articles", sql="SELECT id, array_to_string(list_filter(string_split_regex(lower(content_md), '[^a-z0-9]+'), lambda t: len(t) >= 3), ' ') AS tokens FROM f_articles")
def simhash_tokens(a):
    return a.select("id", F.array_join(X.simhash_tokens(F.col("content_md")), " ").alias("tokens"))


@query("simhash", "f_articles", sql=SIMHASH + "SELECT id, printf('%016x', h) AS simhash FROM sim")
def simhash(a):
    return a.select("id", F.lpad(F.lower(F.hex(article_simhash(F.col("title"), F.col("content_md")))), 16, "0").alias("simhash"))


@query("hamming", "events", sql="SELECT event_id, CAST(bit_count(xor(event_id, user_id)) AS INTEGER) AS distance FROM events")
def hamming_query(e):
    return e.select("event_id", hamming(F.col("event_id"), F.col("user_id")).alias("distance"))


@query("title_tokens", "f_articles", sql=f"SELECT id, array_to_string({TOKENS}, ' ') AS tokens FROM f_articles")
def title_tokens(a):
    return a.select("id", F.array_join(X.title_tokens(F.col("title")), " ").alias("tokens"))


#: Each article with the one before it.
PAIRED = f"WITH t AS (SELECT id, {TOKENS} AS a FROM f_articles), p AS (SELECT x.id, x.a, y.a AS b FROM t x JOIN t y ON y.id = x.id - 1) "


def _paired(a):
    t = a.select("id", X.title_tokens(F.col("title")).alias("a"))
    return t.join(t.select((F.col("id") + 1).alias("id"), F.col("a").alias("b")), "id")


_INTER, _UNION = "len(list_intersect(a, b))", "len(list_distinct(list_concat(a, b)))"
_SIM = f"CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE {_INTER}::DOUBLE / {_UNION} END"
_DIGITS = "list_filter({}, lambda t: regexp_matches(t, '[0-9]'))"
_VERSIONS = f"(len({_DIGITS.format('a')}) = 0 OR len({_DIGITS.format('b')}) = 0 OR list_has_any({_DIGITS.format('a')}, {_DIGITS.format('b')}))"


@query("title_similarity", "f_articles", sql=PAIRED + f"SELECT id, CAST({_INTER} AS INTEGER) AS shared, round({_SIM}, 6) AS similarity FROM p")
def title_similarity(a):
    return _paired(a).select("id", X.shared_tokens(F.col("a"), F.col("b")).alias("shared"), F.round(X.title_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("versions_agree", "f_articles", sql=PAIRED + f"SELECT id, {_VERSIONS} AS agree FROM p")
def versions_agree(a):
    return _paired(a).select("id", X.versions_agree(F.col("a"), F.col("b")).alias("agree"))


@query("same_story", "f_articles", sql=PAIRED + f"SELECT id, {_INTER} >= 4 AND {_VERSIONS} AND {_SIM} >= 0.55 AS same FROM p")
def same_story(a):
    return _paired(a).select("id", X.same_story(F.col("a"), F.col("b")).alias("same"))


@query("slugify", "f_articles", sql=f"SELECT id, {SLUG.format('title')} AS slug FROM f_articles")
def slugify(a):
    return a.select("id", X.slugify(F.col("title")).alias("slug"))


@query("strip_brackets", "f_articles", sql="SELECT id, trim(replace(replace(concat('[[', title, ']]'), '[[', ''), ']]', '')) AS name FROM f_articles")
def strip_brackets(a):
    return a.select("id", X.strip_brackets(F.concat(F.lit("[["), F.col("title"), F.lit("]]"))).alias("name"))


@query("canon_key", "f_links", sql="SELECT from_note, to_slug, replace(regexp_replace(to_slug, '-concept(-[0-9]+)?$', ''), '-', '') AS canon_key FROM f_links")
def canon_key(links):
    return links.select("from_note", "to_slug", X.canon_key(F.col("to_slug")).alias("canon_key"))


@query("display_name", "f_links", sql="SELECT DISTINCT to_slug, regexp_replace(concat(upper(substring(to_slug, 1, 1)), substring(to_slug, 2)), '-([0-9]+)$', '-\\1') AS name FROM f_links".replace("\\\\", "\\"))
def display_name(links):
    return links.select("to_slug").distinct().select("to_slug", X.display_name(F.col("to_slug")).alias("name"))


def _entities(a):
    """An organisation that every fifth article shares, a place (no concept), and a person."""
    of = lambda name, kind: F.struct(name.alias("name"), F.lit(kind).alias("type"))
    return F.array(of(F.concat(F.lit("Org "), (F.col("id") % 5).cast("string")), "ORG"), of(F.lit("Some Place"), "place"), of(F.concat(F.lit("P. "), F.col("author")), "person"))


@query("concept_slugs", "f_articles", sql="SELECT id, array_to_string(list_sort(list_distinct(list_concat(tags, [concat('org-', id % 5), CASE WHEN author = '' THEN 'p' ELSE concat('p-', author) END]))), ',') AS slugs FROM f_articles")
def concept_slugs(a):
    return a.select("id", F.array_join(X.concept_slugs(_entities(a), F.col("tags")), ",").alias("slugs"))


@query("concept_name", "f_articles", sql="SELECT id, CASE WHEN id % 2 = 0 THEN concat('Org ', id % 5) ELSE concat(upper(substring(tags[1], 1, 1)), substring(tags[1], 2)) END AS name FROM f_articles")
def concept_name(a):
    slug = F.when(F.col("id") % 2 == 0, F.concat(F.lit("org-"), (F.col("id") % 5).cast("string"))).otherwise(X.slugify(F.get("tags", F.lit(0))))
    return a.select("id", X.concept_name(_entities(a), F.col("tags"), slug).alias("name"))


@query("domain_pattern", "pages", sql=r"SELECT page_id, replace(regexp_extract(regexp_replace(url, '^https?://', ''), '^([^/?]*)', 1), '.', '\.') AS pattern FROM pages")
def domain_pattern(p):
    return p.select("page_id", X.domain_pattern(F.col("url")).alias("pattern"))


@query("snippet", "documents", sql=r"WITH s AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, CASE WHEN len(t) > 220 THEN concat(substring(t, 1, 220), ' …') ELSE t END AS snippet FROM s")
def snippet(d):
    return d.select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("embed_text", "f_articles", sql="SELECT id, CASE WHEN title = '' THEN substring(trim(content_md), 1, 1200) ELSE concat(title, chr(10), chr(10), substring(trim(content_md), 1, 1200)) END AS text FROM f_articles")
def embed_text(a):
    return a.select("id", X.embed_text(F.col("title"), F.col("content_md")).alias("text"))


@query("article_day", "f_articles", sql="SELECT id, CAST(coalesce(published, fetched_at) AS DATE) AS day FROM f_articles")
def article_day(a):
    return a.select("id", F.to_date(F.coalesce("published", "fetched_at")).alias("day"))


@query("note_day", "f_notes", sql="SELECT id, CASE WHEN id % 3 = 0 THEN DATE '2023-05-06' ELSE CAST(created_at AS DATE) END AS day FROM f_notes")
def note_day(n):
    """A third of the notes say when they were made; another third say something that is no date, or not in their head."""
    said = F.when(F.col("id") % 3 == 0, F.lit('---\ntype: atom\ncreated: "2023-05-06 07:08"\n---\n')).when(F.col("id") % 3 == 1, F.lit("---\ncreated: soon\n---\n\ncreated: 2022-01-01\n")).otherwise("created: 2022-01-01")
    return n.select("id", X.note_day(said, F.col("created_at")).alias("day"))


@query("definition_key", "f_notes", sql="SELECT id, sha256(concat(title, chr(0), array_to_string(list_sort(wikilinks), chr(0)))) AS key FROM f_notes")
def definition_key(n):
    return n.select("id", X.content_key(F.col("title"), F.col("wikilinks")).alias("key"))


_CATEGORIES = ", ".join(f"'{c}'" for c in X.CATEGORIES)


@query("sanitize_category", "f_articles", sql=f"SELECT id, CASE WHEN category IN ({_CATEGORIES}) THEN category ELSE 'general' END AS category, array_to_string(list_distinct(list_transform(tags, lambda t: lower(t))).list_sort(), ',') AS tags, CAST(greatest(0, least(3, importance + 2)) AS INTEGER) AS importance FROM f_articles")
def sanitize_category(a):
    return a.select("id", X.sanitize_category(F.upper("category")).alias("category"), F.array_join(F.array_sort(X.dedupe_tags(F.transform("tags", F.upper))), ",").alias("tags"), X.clamp_importance(F.col("importance") + 2).alias("importance"))


_WIKI = "concat('See [[', array_to_string(wikilinks, '|label]] and [[ '), '#part]].')"


@query("parse_wikilinks", "f_notes", sql="SELECT id, array_to_string(list_sort(list_distinct(wikilinks)), ',') AS links FROM f_notes")
def parse_wikilinks(n):
    text = F.concat(F.lit("See [["), F.array_join("wikilinks", "|label]] and [[ "), F.lit("#part]]."))
    return n.select("id", F.array_join(F.array_sort(X.parse_wikilinks(text)), ",").alias("links"))


@query("note_body", "documents", sql="SELECT doc_id, text AS body FROM documents")
def note_body(d):
    return d.select("doc_id", X.note_body(F.concat(F.lit("---\ntitle: x\n---\n"), F.col("text"))).alias("body"))


@query("extract_links", "pages", sql="SELECT page_id, url, concat('[', page_id, '](', url, ') ') AS text FROM pages")
def extract_links(p):
    text = F.concat(F.lit("["), F.col("page_id"), F.lit("]("), F.col("url"), F.lit(") "))
    links = p.select("page_id", F.explode(X.extract_links(F.concat(text, text, F.col("url"), F.lit(" https://x.example/a.png")))).alias("l"))
    return links.select("page_id", F.col("l.url").alias("url"), F.concat(F.lit("["), F.col("l.text"), F.lit("]("), F.col("l.url"), F.lit(") ")).alias("text"))


@query(
    "normalize_url",
    "pages",
    sql=r"""
WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
s AS (SELECT page_id, regexp_extract(u, '^([^?]*)', 1) AS base, list_sort(list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_source='))) AS q FROM p)
SELECT page_id, regexp_replace(CASE WHEN len(q) > 0 THEN concat(base, '?', array_to_string(q, '&')) ELSE base END, '/$', '') AS url FROM s""",
)
def normalize_url_query(p):
    return p.select("page_id", normalize_url(F.col("url")).alias("url"))


@query("strip_tags", "pages", sql="SELECT page_id, trim(regexp_replace(html, '<[^>]*>', '', 'g'), chr(10) || ' ') AS text FROM pages")
def strip_tags_query(p):
    return p.select("page_id", strip_tags(F.col("html")).alias("text"))


@query("html_to_markdown", "pages")
def html_to_markdown_query(p):
    return html_to_markdown(p.select("page_id", "html"))


@query("extract_pages", "pages")
def extract_pages_query(p):
    return extract_pages(p)


@query("clean_markdown", "documents")
def clean_markdown_query(d):
    """Of every text, in turn as it is, in a fence of html, in an open fence and in one of another language."""
    text = F.coalesce("text", F.lit(""))
    fenced = F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("```html\n"), text, F.lit("\n```"))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("```\n"), text)).when(F.col("doc_id") % 4 == 3, F.concat(F.lit("```py\n"), text, F.lit("\n```\n\n\n\n\nend"))).otherwise(text)
    return d.select("doc_id", clean_markdown(fenced).alias("text"))
