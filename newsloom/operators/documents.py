"""Notes as markdown documents: atoms of articles, electrons of concepts, molecules of themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import excerpt

# Headings and signs of the documents.
SUMMARY, HIGHLIGHTS, ENTITIES, SOURCE, CONNECTIONS = "## Resumen\n", "## Contenido destacado\n", "## Entidades\n", "## Fuente\n", "## Conexiones\n"
DEFINITION, TIMELINE, RELATED, SOURCES = "## Definition\n", "## When it comes up\n", "## Comes up with\n", "## Sources\n"
IDEA, DEVELOPMENT, CONCEPTS = "## Central idea\n", "## How it developed\n", "## Concepts in play\n"
FULL, EMPTY, BAR, MOST_BARS = "★", "☆", "▁", 20
NEEDS_QUOTES = r"""[:#\[\]{}&*!|>'"%@`,]|^[\-?]|^\s|\s$|^$"""


def scalar(value: Column) -> Column:
    """A value of a frontmatter line: quoted only where a bare one would be read otherwise; lines become one."""
    line = F.translate(F.coalesce(value, F.lit("")), "\r\n", "  ")
    escaped = F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(line.rlike(NEEDS_QUOTES), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(line)


def frontmatter(fields: list[tuple[str, Column]], tags: Column) -> Column:
    """Lines of the fields that aren't empty, in order, then the tags."""
    line = lambda name, value: F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.concat(F.lit(f"{name}: "), scalar(value), F.lit("\n")))
    items = F.when(F.size(tags) > 0, F.concat(F.lit("tags:\n"), _lines(tags, lambda t: F.concat(F.lit("  - "), scalar(t))))).otherwise("")
    return F.concat(F.lit("---\n"), *[line(*f) for f in fields], items, F.lit("---\n"))


def _lines(items: Column, text) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(text(x), F.lit("\n"))), "")


def _section(heading: str, items: Column, text) -> Column:
    """A heading and its lines; nothing without items."""
    return F.when(F.size(items) > 0, F.concat(F.lit(heading), _lines(items, text), F.lit("\n"))).otherwise("")


def stars(importance: Column) -> Column:
    n = F.greatest(F.lit(0), F.least(F.lit(5), importance))
    return F.concat(F.repeat(F.lit(FULL), n), F.repeat(F.lit(EMPTY), F.lit(5) - n))


def note_time(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm")


def note_day(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd")


def render_atoms(articles: DataFrame) -> DataFrame:
    """(id, document) of articles (id, title, summary, content_md, category, importance, tags, published, fetched_at, source_name, url) with
    ``entities`` (array of name, type), ``concepts`` (slugs it links to) and ``coverage`` (array of name, url: other outlets)."""
    c = F.col
    tags = F.concat(F.array(F.lit("atom"), F.lit("ai")), c("tags"))
    fields = [("type", F.lit("atom")), ("created", note_time(F.coalesce("published", "fetched_at"))), ("source", c("source_name")), ("url", c("url")), ("rating", stars(c("importance"))), ("category", c("category"))]
    part = lambda heading, text: F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(F.concat(F.lit(heading), text, F.lit("\n\n")))
    link = lambda name, url: F.concat(F.lit("["), name, F.lit("]("), url, F.lit(")"))
    covered = F.when(F.size("coverage") > 0, F.concat(F.lit("\nAlso covered by "), F.size("coverage").cast("string"), F.lit(" other outlet(s):\n"), _lines(c("coverage"), lambda x: F.concat(F.lit("- "), link(x["name"], x["url"]))))).otherwise("")
    document = F.concat(
        frontmatter(fields, tags),
        F.lit("\n# "), c("title"), F.lit("\n\n"),
        part(SUMMARY, c("summary")),
        part(HIGHLIGHTS, F.when(F.coalesce("content_md", F.lit("")) != "", excerpt(c("content_md"), 600))),
        _section(ENTITIES, c("entities"), lambda e: F.concat(F.lit("- **"), e["name"], F.lit("** ("), e["type"], F.lit(")"))),
        F.lit(SOURCE), link(c("source_name"), c("url")), F.lit("\n"), covered, F.lit("\n"),
        _section(CONNECTIONS, c("concepts"), lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))),
    )
    return articles.select("id", document.alias("document"))


def redirect_document(title: Column, name: Column, slug: Column, created: Column) -> Column:
    """The note of a concept that was merged into another: it leads there, for links that still lead here."""
    fields = [("type", F.lit("electron")), ("created", note_time(created)), ("status", F.lit("merged"))]
    return F.concat(frontmatter(fields, F.array(F.lit("ai"), F.lit("concept"))), F.lit("\n# "), title, F.lit("\n\nMerged into [["), slug, F.lit("]] — "), name, F.lit(".\n"))


def render_electrons(views: DataFrame, created: Column) -> DataFrame:
    """(slug, document) of concept views: slug, name, definition (or null), sources (array of slug, title), related (array of slug, name, shared), months (array of month, n)."""
    c = F.col
    named = F.concat(F.lit("A recurring idea in the feed, named in "), F.size("sources").cast("string"), F.lit(" note(s)."))
    bar = lambda n: F.when(n > 0, F.concat(F.lit("  "), F.repeat(F.lit(BAR), F.least(n, F.lit(MOST_BARS)).cast("int")))).otherwise("")
    head = frontmatter([("type", F.lit("electron")), ("created", note_time(created)), ("status", F.lit("active"))], F.array(F.lit("ai"), F.lit("concept")))
    document = F.concat(
        head, F.lit("\n# "), c("name"), F.lit(f"\n\n{DEFINITION}"), F.coalesce(F.nullif(c("definition"), F.lit("")), named), F.lit("\n\n"),
        _section(TIMELINE, c("months"), lambda m: F.concat(F.lit("- "), m["month"], F.lit(" · "), m["n"].cast("string"), F.lit(" mention(s)"), bar(m["n"]))),
        _section(RELATED, c("related"), lambda r: F.concat(F.lit("- [["), r["slug"], F.lit("]] — "), r["name"], F.lit(" · "), r["shared"].cast("string"), F.lit(" shared note(s)"))),
        _section(SOURCES, c("sources"), lambda s: F.concat(F.lit("- [["), s["slug"], F.lit("]] — "), s["title"])),
    )
    return views.select("slug", document.alias("document"))


def theme_gist(notes: Column, concepts: Column) -> Column:
    """What is true of a theme without asking a model: how many notes, between which days, around which concepts."""
    days = F.array_sort(F.filter(F.transform(notes, lambda n: n["day"]), lambda d: d.isNotNull() & (d != "")))
    first, last = F.get(days, F.lit(0)), F.get(days, F.size(days) - 1)
    span = F.when(first.isNull(), "").when(first == last, F.concat(F.lit(" on "), first)).otherwise(F.concat(F.lit(" between "), first, F.lit(" and "), last))
    names = F.transform(concepts, lambda x: x["name"])
    n = F.size(names)
    joined = F.when(n <= 1, F.array_join(names, "")).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(names, n - 1)))
    counted = F.concat(F.size(notes).cast("string"), F.lit(" note(s)"), span)
    return F.when(n == 0, F.concat(counted, F.lit(", gathered here."))).otherwise(F.concat(counted, F.lit(" name "), joined, F.lit(" together.")))


def render_molecules(themes: DataFrame) -> DataFrame:
    """(slug, document) of themes: slug, title, created, summary (or null), concepts (array of slug, name, notes, total), notes (array of slug, title, day)."""
    c = F.col
    head = frontmatter([("type", F.lit("molecule")), ("created", note_time(c("created"))), ("status", F.lit("active"))], F.array(F.lit("synthesis"), F.lit("ai"), F.lit("theme")))
    day = lambda n: F.when(F.coalesce(n["day"], F.lit("")) == "", "").otherwise(F.concat(n["day"], F.lit(" · ")))
    document = F.concat(
        head, F.lit("\n# 🧪 "), c("title"), F.lit(f"\n\n{IDEA}"), F.coalesce(F.nullif(c("summary"), F.lit("")), theme_gist(c("notes"), c("concepts"))), F.lit("\n\n"),
        _section(DEVELOPMENT, c("notes"), lambda n: F.concat(F.lit("- "), day(n), F.lit("[["), n["slug"], F.lit("]] — "), n["title"])),
        _section(CONCEPTS, c("concepts"), lambda x: F.concat(F.lit("- [["), x["slug"], F.lit("]] — "), x["name"], F.lit(" · "), x["notes"].cast("string"), F.lit(" note(s) here, "), x["total"].cast("string"), F.lit(" in all"))),
    )
    return themes.select("slug", document.alias("document"))
