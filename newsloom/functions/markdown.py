"""HTML to markdown, readable bodies of pages, and cleaning of markdown."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import trimmed

MIN_LENGTH = 200
_BLOCKS = frozenset("p div section article main header footer ul ol table tr blockquote pre figure h1 h2 h3 h4 h5 h6 li".split())
_SKIPPED = frozenset("script style noscript template svg head iframe".split())
_UNREADABLE = frozenset("nav footer aside form button".split())


def strip_tags(html: Column) -> Column:
    """Text outside of tags, trimmed."""
    return trimmed(F.regexp_replace(html, "<[^>]*>", ""))


#: Names of meta elements that say who wrote a page.
_AUTHORS = ("author", "article:author", "dc.creator")


class _Writer(HTMLParser):
    """Writes blocks, emphasis, links, lists and code of a page as markdown; with ``readable``, without navigation and the like."""

    def __init__(self, readable: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.readable, self.out, self.lists, self.links = readable, [], [], []
        self.skip = self.code = 0
        self.title, self.in_title, self.article_at, self.article_end = "", False, None, None
        self.byline = ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.in_title = True
        if tag == "meta" and not self.byline:
            named = {k: v or "" for k, v in attrs}
            self.byline = named.get("content", "") if (named.get("name") or named.get("property", "")).lower() in _AUTHORS else ""
        if tag in _SKIPPED or self.readable and (tag in _UNREADABLE or tag == "div" and "ad" in dict(attrs).get("class", "").split()) or self.skip and tag == "div":
            self.skip += 1
        if self.skip:
            return
        if tag in ("article", "main") and self.article_at is None:
            self.article_at = len(self.out)
        if tag in _BLOCKS:
            self.out.append("\n\n" if tag not in ("li", "tr") else "\n")
        if tag[:1] == "h" and tag[1:].isdigit():
            self.out.append("#" * int(tag[1:]) + " ")
        elif tag == "li":
            self.lists[-1:] = [self.lists[-1] + 1] if self.lists and self.lists[-1] is not None else self.lists[-1:]
            self.out.append(f"{self.lists[-1]}. " if self.lists and self.lists[-1] else "- ")
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre":
            self.code += 1
            self.out.append("```\n")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "blockquote":
            self.out.append("> ")
        elif tag == "a":
            self.links.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
        if self.skip:
            if tag in _SKIPPED or tag in _UNREADABLE or tag == "div":
                self.skip -= 1
            return
        if tag in ("b", "strong"):
            self.out.append("**")
        elif tag in ("i", "em"):
            self.out.append("*")
        elif tag == "pre" and self.code:
            self.code -= 1
            self.out.append("\n```")
        elif tag == "code" and not self.code:
            self.out.append("`")
        elif tag == "a" and self.links:
            self.out.append(f"]({self.links.pop()})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
        if tag in ("article", "main") and self.article_at is not None and self.article_end is None:
            self.article_end = len(self.out)
        if tag in _BLOCKS:
            self.out.append("\n\n" if tag not in ("li", "tr") else "\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title += data
        if not self.skip:
            self.out.append(data if self.code else " ".join(data.split()).join((" " if data[:1].isspace() else "", " " if data[-1:].isspace() else "")) if data.strip() else " ")

    def markdown(self, article_only: bool = False) -> str:
        parts = self.out[self.article_at : self.article_end] if article_only and self.article_at is not None else self.out
        lines = [x.rstrip() if x.strip() else "" for x in "".join(parts).split("\n")]
        out: list[str] = []
        for line in lines:
            if line or out and out[-1]:
                out.append(line.lstrip() if not self.code else line)
        return "\n".join(out).strip()


def _write(html: str, readable: bool) -> _Writer:
    writer = _Writer(readable)
    writer.feed(html)
    writer.close()
    return writer


def html_to_markdown(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``markdown`` in the place of the html column. Null stays null."""

    @F.pandas_udf("string")
    def convert(html: pd.Series) -> pd.Series:
        return html.map(lambda h: None if h is None else _write(h, False).markdown())

    return pages.select(*[c for c in pages.columns if c not in (column, "markdown")], convert(column).alias("markdown"))


def extract_pages(pages: DataFrame, column: str = "html", least: int = MIN_LENGTH) -> DataFrame:
    """``pages`` with title, byline, markdown and outcome of their readable body in the place of the html column.

    A body under ``least`` characters falls back to the page's plain text; if that is short too the outcome is
    ``failed`` and markdown is null, else it is ``extracted``. Markdown is cleaned.
    """

    @F.pandas_udf("struct<title:string,byline:string,markdown:string,text:string>")
    def read(html: pd.Series) -> pd.DataFrame:
        rows = [_write(h or "", True) for h in html]
        return pd.DataFrame({"title": [" ".join(w.title.split()) for w in rows], "byline": [" ".join(w.byline.split()) for w in rows], "markdown": [w.markdown(True) for w in rows], "text": [w.markdown() for w in rows]})

    kept = [c for c in pages.columns if c not in (column, "title", "byline", "markdown", "outcome")]
    found = pages.select(*kept, read(column).alias("_r"))
    body = F.when(F.length("_r.markdown") >= least, F.col("_r.markdown")).when(F.length("_r.text") >= least, F.col("_r.text"))
    out = found.select(*kept, F.col("_r.title").alias("title"), F.col("_r.byline").alias("byline"), clean_markdown(body).alias("markdown"))
    return out.withColumn("outcome", F.when(F.col("markdown").isNull(), "failed").otherwise("extracted"))


def clean_markdown(markdown: Column) -> Column:
    """Fenced blocks that hold html are unwrapped, other fences stay, an open one is closed, runs of blank lines are cut to two."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("block"), F.lit("").alias("fence"))

    def emitted(s: Column) -> Column:
        is_html = F.startswith(trimmed(F.array_join(s["block"], "\n")), F.lit("<"))
        fenced = F.concat(F.array(s["fence"]), s["block"], F.array(F.lit("```")))
        return F.concat(s["out"], F.when(is_html, s["block"]).otherwise(fenced))

    def step(s: Column, line: Column) -> Column:
        mark = F.startswith(trimmed(line), F.lit("```"))
        none = F.array().cast("array<string>")
        opened = F.struct(s["out"].alias("out"), none.alias("block"), trimmed(line).alias("fence"))
        closed = F.struct(emitted(s).alias("out"), none.alias("block"), F.lit("").alias("fence"))
        inside = F.struct(s["out"].alias("out"), F.concat(s["block"], F.array(line)).alias("block"), s["fence"].alias("fence"))
        outside = F.struct(F.concat(s["out"], F.array(line)).alias("out"), none.alias("block"), F.lit("").alias("fence"))
        return F.when(mark & (s["fence"] == ""), opened).when(mark, closed).when(s["fence"] != "", inside).otherwise(outside)

    done = F.aggregate(F.split(markdown, "\n"), start, step, lambda s: F.array_join(F.when(s["fence"] != "", emitted(s)).otherwise(s["out"]), "\n"))
    text = F.when(F.contains(markdown, F.lit("```")), done).otherwise(markdown)  # the fold costs the square of the lines
    return trimmed(F.regexp_replace(text, "\n{4,}", "\n\n\n"))
