"""Spelling variants of a corpus' words, by pivotal bigrams.

A word's bigrams are ordered by how many words hold them. Its prefix is its three rarest bigrams (and what
ties with the last), its pivots are two bigrams of the prefix that don't overlap and are the rarest such two. One edit
spoils at most one of two bigrams that don't overlap, so of two words at one edit, the one whose prefix ends first in
that order has a pivot which the other holds too, and holds in its prefix, as its prefix goes further. Pivots are
therefore looked up among the prefixes of the other words that end no earlier, at the places and lengths that one edit allows: the
same place for a replaced letter, the same or the next for an inserted or deleted one. What meets is verified by its edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed, release, table

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, FACTOR, SPOILT = 6, 5, 5, 199
#: Characters of a text that are read at a time, and distinct words that a task counts before it hands them on.
PIECE, HELD = 1 << 20, 200_000
#: Pivots of one key that a task compares at a time: keys with more are dealt to several.
BLOCK = 512
_RUN, _OTHER = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def lowered(run: str) -> str:
    """``run`` with only A-Z in lower case."""
    return run.lower() if run.isascii() else run.translate(_LOWER)


def runs(text: str, piece: int = PIECE) -> Counter[str]:
    """Lower-cased runs of letters and how often each occurs; a long text is read in pieces, cut where a run ends."""
    found: Counter[str] = Counter()
    at = 0
    while at < len(text):
        cut = _OTHER.search(text, at + piece)
        end = cut.start() if cut else len(text)
        found.update(_RUN.findall(text, at, end))
        at = end
    out: Counter[str] = Counter()
    for run, n in found.items():
        out[lowered(run)] += n
    return out


def spoilt(run: str, start: int) -> str:
    """``run`` without one code point if 199 divides its checksum, which goes on from that of the document's id."""
    h = zlib.crc32(run.encode(), start)
    if h % SPOILT:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame, key: str = "doc_id", column: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of words of at least ``least_length`` code points and ``least_count`` occurrences in all of ``docs``.

    A task counts the words of its documents before they are shuffled, so a frequent word is a few rows. A null text has no words, a
    null key is empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total: Counter[str] = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column("key"), batch.column("text"), strict=True):
                start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for own, n in runs(text.as_py() or "").items():
                    word = spoilt(own, start)
                    if len(word) >= least_length:
                        total[word] += n
                if len(total) > HELD:
                    yield handed()
                    total.clear()
        yield handed()

    counted = docs.select(F.col(key).cast("string").alias("key"), F.col(column).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rarest_disjoint(places: list[int], weights: list[int], size: int = 2) -> list[int]:
    """Indexes of the ``size`` grams of least total weight of which no two overlap, by dynamic programming along ``places`` (ascending).

    ``best[m]`` is the least weight of m such grams among those seen so far, with the grams chosen; a gram of two letters
    may follow any that starts two places before it.
    """
    best: list[list[tuple[int, list[int]]]] = []
    for i, (place, weight) in enumerate(zip(places, weights, strict=True)):
        before = next((best[j] for j in range(i - 1, -1, -1) if places[j] <= place - 2), [(0, [])])
        row = list(best[-1]) if best else [(0, [])]
        for m, (total, chosen) in enumerate(before[:size]):
            new = (total + weight, [*chosen, i])
            if m + 1 >= len(row):
                row.append(new)
            elif new < row[m + 1]:
                row[m + 1] = new
        best.append(row)
    return best[-1][size][1]


def signature(word: str, order: dict[str, tuple[int, int]]) -> tuple[int, list[tuple[str, int]], list[tuple[str, int]]]:
    """(rank of the prefix's last bigram, prefix, pivots) of a word, where ``order`` gives each bigram's rank and weight.

    The prefix holds every place of a bigram that is no rarer than its third, so a repeated bigram is in it wholly.
    """
    grams = [word[i : i + 2] for i in range(len(word) - 1)]
    ranks = [order[g][0] for g in grams]
    last = sorted(ranks)[2]
    places = [i for i, r in enumerate(ranks) if r <= last]
    pivots = rarest_disjoint(places, [order[grams[i]][1] for i in places])
    return last, [(grams[i], i) for i in places], [(grams[places[i]], places[i]) for i in pivots]


def _signatures(words: DataFrame) -> DataFrame:
    """(word, n, length, last, prefix, pivots) of all words of at least four code points.

    Words hold 90 different letters, so there are at most 8,100 different bigrams to collect, whatever the words.
    """
    bigrams = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    counted = words.select(F.explode(bigrams).alias("gram")).groupBy("gram").count().collect()
    order = {r["gram"]: (i, r["count"]) for i, r in enumerate(sorted(counted, key=lambda r: (r["count"], r["gram"])))}
    gram = pa.list_(pa.struct([("gram", pa.string()), ("place", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("word").to_pylist()
            found = [signature(w, order) for w in own]
            lists = [pa.array([[{"gram": g, "place": i} for g, i in f[k]] for f in found], gram) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array([len(w) for w in own], pa.int32()), pa.array([f[0] for f in found], pa.int32()), *lists], ["word", "n", "length", "last", "prefix", "pivots"])

    return words.select("word", "n").mapInArrow(run, "word string, n long, length int, last int, prefix array<struct<gram: string, place: int>>, pivots array<struct<gram: string, place: int>>")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of all words (word, n; distinct, of at least four code points) at one edit, each pair in both directions.

    A key is a bigram, its place and the word's length. Keys with more than ``BLOCK`` pivots are dealt to blocks, to each of which
    their prefixes are copied, so no key is one task.
    """
    signed = checkpointed(_signatures(words))
    key = ["gram", "place", "length"]
    # a word is carried as what stands before and after the bigram
    before, after = F.expr("substring(word, 1, g.place)"), F.expr("substring(word, g.place + 3)")
    pivots = signed.select("word", "n", "last", "length", F.explode("pivots").alias("g")).select(before.alias("l"), after.alias("r"), "n", "last", "g.gram", "g.place", "length")
    hot = pivots.groupBy(*key).agg(F.count("*").alias("held")).where(F.col("held") > BLOCK).select(*key, F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    hot = checkpointed(hot)
    # where a pivot of a word stands in another, and how long that one is, after one edit
    moves = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(l).alias("l")) for p, l in ((0, 0), (0, 1), (1, 1), (0, -1), (-1, -1))])
    prefixes = signed.select("word", "n", "last", "length", F.explode("prefix").alias("g")).select(before.alias("other_l"), after.alias("other_r"), F.col("n").alias("other_n"), F.col("last").alias("other_last"), "length", "g.gram", "g.place", F.explode(moves).alias("m"))
    prefixes = prefixes.select("other_l", "other_r", "other_n", "other_last", "gram", (F.col("place") - F.col("m.p")).alias("place"), (F.col("length") - F.col("m.l")).alias("length"))
    blocks = F.coalesce("blocks", F.lit(1))
    dealt = pivots.join(hot, key, "left").withColumn("block", F.pmod(F.xxhash64("l", "r"), blocks).cast("int")).drop("blocks")
    copied = prefixes.join(hot, key, "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("blocks")
    # one edit leaves one side of the bigram as it was, and is all that the other side may differ by
    met = dealt.join(copied, [*key, "block"]).where("other_last >= last AND (l = other_l AND levenshtein(r, other_r, 1) = 1 OR r = other_r AND levenshtein(l, other_l, 1) = 1)")
    near = met.select(F.concat("l", "gram", "r").alias("word"), "n", F.concat("other_l", "gram", "other_r").alias("other"), "other_n")
    return near.unionByName(near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))).distinct()


def with_roots(forms: DataFrame) -> DataFrame:
    """(word, form) with ``root``: the word at the end of the chain of forms, by pointer jumping; the word itself without a form.

    A form occurs several times as often as its word, so there is no circle, and the rounds grow with the logarithm of the
    longest chain, which itself grows with the logarithm of the largest count.
    """
    ends = forms.select("word", "form", F.coalesce("form", "word").alias("root"))
    while True:
        ends = checkpointed(ends)
        links = ends.where("root <> word").select(F.col("word").alias("w"), F.col("root").alias("next"))
        further = ends.join(links, ends["root"] == links["w"], "left")
        if further.where("next IS NOT NULL").isEmpty():
            return ends
        ends = further.select("word", "form", F.coalesce("next", "root").alias("root"))


def spelling_variants(docs: DataFrame, key: str = "doc_id", column: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs``.

    ``form`` is the near word of largest count, ties to the smallest in code-point order, if it occurs at least ``factor`` times
    as often as the word; else null. Null and empty texts have no words and an empty table gives no row; repeated rows
    count each time; texts of any length are read whole. Other columns aren't read.
    """
    if least_length < 4:
        raise ValueError("words need three bigrams")
    words = checkpointed(count_words(docs, key, column, least_length, least_count))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word"))).alias("best"))
    joined = words.join(best.withColumnRenamed("word", "w"), F.col("word") == F.col("w"), "left")
    often = -F.col("best.less") >= factor * F.col("n")
    forms = checkpointed(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(often, F.col("best.word")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")))
    roots = with_roots(forms.select("word", "form")).select("word", "root")
    return forms.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: Checksums byte by byte from the rule of the polynomial; words are near if deleting the code point at some place gives the other word, or the same rest.
OP12_SQL = r"""
WITH step AS MATERIALIZED (SELECT list(list_reduce(list_prepend(b, [1, 2, 3, 4, 5, 6, 7, 8]), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) ORDER BY b) AS t FROM range(256) AS r(b)),
found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM found GROUP BY ALL),
bytes AS (SELECT doc_id, run, n, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS b FROM low),
summed AS (SELECT doc_id, run, n, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM bytes, step),
words AS (SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM summed),
vocabulary AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
rest AS MATERIALIZED (SELECT word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) AS r FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM rest a JOIN rest b ON a.r = b.r AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM rest a JOIN vocabulary b ON a.r = b.word UNION SELECT b.word, b.n, a.word, a.n FROM rest a JOIN vocabulary b ON a.r = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, hex(encode(other))) AS form, max(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN form END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE c(word, root) AS (SELECT word, coalesce(form, word) FROM forms UNION SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL) SELECT * FROM c),
root AS (SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN root USING (word)
"""
