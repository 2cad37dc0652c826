"""Benchmark decontamination with an Aho-Corasick automaton.

Texts are normalised to words with one space between them. The automaton holds every window of the
benchmark's normalised items, with a space at either end so that only whole words match. A document is
scanned once; where a window ends is mapped back to words, and words to their place in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import table, text_bytes, unused, with_arrow_columns

WINDOW = 10
#: Bytes of item text that one task's automaton holds; a larger benchmark is dealt to several by hash, of which each text is scanned by all.
AUTOMATON_BYTES = 4 << 20

#: A-Z to a-z, everything that is not a digit, a letter or beyond ASCII to a space.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows_of(text: bytes, size: int = WINDOW) -> list[bytes]:
    """The normalised windows of an item: of ``size`` words, or one of all words if it has fewer."""
    words = words_of(text)
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


class Automaton:
    """Finds windows in normalised texts; each window knows its length in words and its items."""

    def __init__(self, items: list[tuple[str | None, bytes]], size: int) -> None:
        found: dict[bytes, set[str]] = {}
        for key, text in items:
            for window in windows_of(text, size):
                found.setdefault(window, set()).update([] if key is None else [key])
        self.automaton = ahocorasick.Automaton()
        for window, keys in found.items():
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, frozenset(keys)))
        self.empty = not found
        if found:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, after last) in order, and the items that occur."""
        if self.empty or not words:
            return [], set()
        keys: set[str] = set()
        ends, sizes = [], []
        for end, (n, own) in self.automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
            ends.append(end)
            sizes.append(n)
            keys |= own
        if not ends:
            return [], keys
        after = np.cumsum([len(w) + 1 for w in words])  # of the space after each word
        last = np.searchsorted(after, ends)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, last - np.array(sizes) + 1, 1)
        np.add.at(edge, last + 1, -1)
        hit = np.diff(np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8))
        return list(zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist(), strict=True)), keys


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def original_spans(text: bytes, spans: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as code-point offsets (start, end) in the original text."""
    places = [m.span() for m in _WORD.finditer(text)]
    # an upper-case letter is a word character too: the pattern runs over the text as it is
    points = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    return [{"start": int(points[places[a][0]]) - 1, "end": int(points[places[b - 1][1] - 1])} for a, b in spans]


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items (id as text, text), dealt by hash to blocks of about ``limit`` bytes; one block at a time is on the driver."""
    items = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("string").alias("k"), F.col("text").cast("binary").alias("t")).distinct()
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = 1 + total // limit
    block = F.pmod(F.xxhash64("k", "t"), F.lit(blocks))
    for number in range(blocks):
        yield sorted(((r["k"], bytes(r["t"])) for r in items.where(block == number).collect()), key=lambda item: (item[0] or "", item[1]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items (sorted ids as text), spans (in the original text), items_sha256 and contaminated.

    The size of the benchmark is looked up first: up to ``block_bytes`` it is one automaton, which each task builds;
    above, as many as it takes, with the same results. Null and empty texts have no words and are clean; null
    items and items without words match nothing; an item without an id counts for hits and is in no list.
    Repeated items and rows change nothing. Columns of the same names are replaced.
    """
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    (runs_column,) = unused(docs.columns, "_runs")
    own = [T.StructField("n_words", T.LongType()), T.StructField(runs_column, T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
    final = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", span), T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())]
    out = docs
    sent_blocks = [docs.sparkSession.sparkContext.broadcast(block) for block in _blocks(benchmark, block_bytes)]
    for number, sent in enumerate(sent_blocks):
        first, last = number == 0, number == len(sent_blocks) - 1

        def make(sent=sent, first=first, last=last):
            automaton = Automaton(sent.value, size)

            def compute(batch: pa.RecordBatch) -> list:
                rows = []
                before = [(None, None)] * batch.num_rows if first else list(zip(batch.column(runs_column).to_pylist(), batch.column("items").to_pylist(), strict=True))
                for text, (runs, items) in zip(text_bytes(batch, "text"), before, strict=True):
                    words = words_of(text)
                    spans, keys = automaton.scan(words)
                    if runs:
                        spans = _merged(spans + list(zip(runs[::2], runs[1::2], strict=True)))
                    keys = sorted(keys.union(items or ()))
                    if not last:
                        rows.append((len(words), [x for s in spans for x in s], keys))
                        continue
                    n_hit = sum(b - a for a, b in spans)
                    digest = hashlib.sha256(",".join(keys).encode()).hexdigest()
                    rows.append((len(words), n_hit, len(keys), keys, original_spans(text, spans) if spans else [], digest, n_hit > 0))
                fields = final if last else own
                return [pa.array(c, T_ARROW[f.dataType.simpleString()]) for c, f in zip(zip(*rows, strict=True), fields, strict=True)]

            return compute

        out = with_arrow_columns(out, final if last else own, make, drop=(runs_column,) if not first else ())
    return out


T_ARROW = {
    "bigint": pa.int64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<string>": pa.list_(pa.string()),
    "array<struct<start:bigint,end:bigint>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
}


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
#: Windows of documents are joined with windows of items, for each length that an item's windows have.
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS_SQL} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {WINDOW}) AS k, array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' ') AS s
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT dw.r, dw.i, dw.k, bw.item FROM dw JOIN bw USING (k, s)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM m)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
