"""Generated documents written over what a reader has made of them."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.operators.documents import NEEDS_QUOTES

START, END = "<!-- generated:start -->", "<!-- generated:end -->"
#: Properties of a document's head that are generated; all others are the reader's.
GENERATED = ("type", "created", "status", "source", "url", "rating", "category", "tags")
_HEAD = re.compile(r"\A---\n.*?\n---\n", re.S)
_KEY = re.compile(r"([A-Za-z0-9_.-]+):")


def _head(text: str) -> str:
    """The leading block of properties with its delimiters; empty if there is none."""
    found = _HEAD.match(text)
    return found[0] if found else ""


def _properties(head: str) -> dict[str, list[str]]:
    """Lines of each property, as they are and in the order of first appearance; what comes before any is left out."""
    out: dict[str, list[str]] = {}
    own: list[str] | None = None
    for line in head.splitlines(keepends=True)[1:-1]:
        if key := _KEY.match(line):
            own = out.setdefault(key[1], [])
        if own is not None:
            own.append(line)
    return out


def _plain(item: str) -> str:
    item = item.strip()
    if len(item) > 1 and item[0] == item[-1] == '"':
        return re.sub(r"\\(.)", r"\1", item[1:-1])
    return item[1:-1].replace("''", "'") if len(item) > 1 and item[0] == item[-1] == "'" else item


def _listed(lines: list[str]) -> list[str]:
    return [_plain(x[4:]) for x in lines if x.startswith("  - ")]


def _quoted(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace('"', '\\"')
    return f'"{escaped}"' if re.search(NEEDS_QUOTES, value) else value


def merged_head(old: str, new: str, last_tags: list[str]) -> str:
    """The generated properties as they are now, then the reader's own as they wrote them; their tags join the generated ones."""
    if not old or not new:
        return new
    mine, fresh = _properties(old), _properties(new)
    known = {*last_tags, *_listed(fresh.get("tags", []))}
    added = [t for t in dict.fromkeys(_listed(mine.get("tags", []))) if t and t not in known]
    tags = ([] if "tags" in fresh else ["tags:\n"]) + [f"  - {_quoted(t)}\n" for t in added] if added else []
    own = [line for key, lines in mine.items() if key not in GENERATED for line in lines]
    return "".join([new.removesuffix("---\n"), *tags, *own, "---\n"])


def merged_text(old: str, new: str, last_tags: list[str]) -> str | None:
    """``old`` with its generated region and properties renewed from ``new``; None if its markers don't enclose a region."""
    begin, end = old.find(START), old.find(END)
    if begin < 0 or end < begin:
        return None
    theirs, ours = _head(old), _head(new)
    return merged_head(theirs, ours, last_tags) + old[len(theirs) : begin] + f"{START}\n{new[len(ours):].lstrip(chr(10))}{END}" + old[end + len(END) :]


@F.pandas_udf(T.StringType())
def _merged(old: pd.Series, new: pd.Series, tags: pd.Series) -> pd.Series:
    return pd.Series([None if o is None else merged_text(o, n or "", list(t) if t is not None else []) for o, n, t in zip(old, new, tags, strict=True)], dtype=object)


def marked(text: Column) -> Column:
    """A rendered document with its body between the markers; its properties stay before them."""
    head = F.regexp_extract(text, r"(?s)\A(---\n.*?\n---\n)", 1)
    body = F.regexp_replace(F.substr(text, F.length(head) + 1), r"\A\n+", "")
    return F.concat(head, F.lit(f"{START}\n"), body, F.lit(f"{END}\n"))


def reconcile_documents(rendered: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, outcome, text, hash) of rendered (path, text) against stored documents (path, text, last_hash, last_tags).

    ``created``: nothing was stored. ``replaced``: it is as it was last written, or has no markers and was never
    written. ``merged``: the reader changed it; the generated region and properties are renewed, and their text around the region, their
    properties and their tags (those not in ``last_tags``) stay. ``kept``: they took the markers out, or out of order, so nothing is
    touched. ``hash`` is that of what is written, to be held as the next ``last_hash``; of a kept document it stays. Paths are unique on either side;
    a null rendered text is empty.
    """
    new = rendered.select("path", F.coalesce("text", F.lit("")).alias("_new"))
    old = stored.select("path", F.col("text").alias("_old"), F.col("last_hash").alias("_hash"), F.col("last_tags").alias("_tags"))
    both = new.join(old, "path", "left")
    never = F.coalesce("_hash", F.lit("")) == ""
    whole = ~never & (F.sha2(F.col("_old").cast("binary"), 256) == F.col("_hash")) | never & ~F.contains("_old", F.lit(START))
    edited = both.withColumn("_mine", F.when(~whole, F.col("_old"))).withColumn("_merged", _merged("_mine", "_new", "_tags"))
    outcome = F.when(F.col("_old").isNull(), "created").when(F.col("_mine").isNull(), "replaced").when(F.col("_merged").isNull(), "kept").otherwise("merged")
    text = F.when(outcome == "kept", F.col("_old")).when(outcome == "merged", F.col("_merged")).otherwise(marked(F.col("_new")))
    out = edited.select("path", outcome.alias("outcome"), text.alias("text"), "_hash")
    return out.select("path", "outcome", "text", F.when(F.col("outcome") == "kept", F.col("_hash")).otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("hash"))
