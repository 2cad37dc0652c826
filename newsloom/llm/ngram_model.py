"""Character n-gram language models, counted and smoothed by Spark.

An n-gram of ``ORDER`` characters is one 60-bit code, ``CLASS_BITS`` for each: characters up to U+07FF as they are
(in lower case, all white space one space), the others hashed. The codes are the hashes under which everything
is stored: their rests give the shorter n-grams and the contexts, so that counting and smoothing are joins and
groups by code, and grow with what the corpus holds.

Texts are read in blocks of rows. A block gives, for each language and hash bucket, a sorted array of its
n-grams and one of their counts (compressed). Per bucket these are summed over all blocks; modified Kneser-Ney
makes probabilities of the sums, order by order; and per bucket again each block's n-grams are looked up in the
sorted array of the model by binary search. So a block gets back the values of its own n-grams alone, as sorted
arrays, and no task or driver holds the model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed, release

ORDER, CLASS_BITS = 5, 12
#: Text bytes of a block and of the parts in which its rows are read, and characters that one numpy pass takes.
BLOCK_BYTES, PART_BYTES, PASS_CHARS = 16 << 20, 2 << 20, 1 << 18
#: N-grams that the model of all languages counts for beside a language's own.
PRIOR_GRAMS = 20_000
#: Discounts and sizes of so many models are sent to every task; of more they are joined.
SENT_MODELS = 10_000
#: The language that a null one counts as, and the model of all languages.
OTHER, EVERY = "other", "every"
_EXACT, _PRIME = 1 << CLASS_BITS - 1, 1_000_003


def normal_form(text: bytes) -> str:
    """Words in lower case with one space after each; empty without words."""
    words = text.replace(b"\0", b" ").split()
    return b" ".join([*words, b""]).decode("utf-8", "replace").lower()


def _classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = points.astype(np.int64)
    far = points >= _EXACT
    if far.any():
        out[far] = _EXACT + ((points[far].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - CLASS_BITS)).astype(np.int64)
    return out


def gram_codes(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Codes of the n-grams that end at each character of some normalised texts, in passes of bounded size.

    Yields the index of the first text of a pass, the ends of its texts, and codes. A text begins behind
    ``ORDER - 1`` zeros; a text longer than a pass goes on in the next one, behind its last characters.
    """
    pad = "\0" * (ORDER - 1)
    pieces = [(i, text[a : a + PASS_CHARS], text[max(0, a - ORDER + 1) : a] if a else pad) for i, text in enumerate(texts) for a in range(0, max(len(text), 1), PASS_CHARS)]
    at = 0
    while at < len(pieces):
        after, size = at, 0
        while after < len(pieces) and (after == at or size + len(pieces[after][1]) <= PASS_CHARS) and (after == at or pieces[after][0] != pieces[after - 1][0]):
            size += len(pieces[after][1])
            after += 1
        some = pieces[at:after]
        classes = _classes("".join([before.rjust(ORDER - 1, "\0") + text for _, text, before in some]))
        code = classes.copy()
        for k in range(1, ORDER):
            code[k:] |= classes[:-k] << CLASS_BITS * k
        sizes = np.array([len(text) for _, text, _ in some])
        own = np.ones(len(classes), bool)
        starts = np.cumsum(sizes + ORDER - 1) - sizes - ORDER + 1
        own[(starts[:, None] + np.arange(ORDER - 1)).reshape(-1)] = False
        yield some[0][0], np.cumsum(sizes), code[own]
        at = after


def bucket_of(codes: np.ndarray | Column, buckets: int) -> np.ndarray | Column:
    """The bucket of codes, in numpy and in Spark: that of all their characters but the last two."""
    context = F.shiftright(codes, 2 * CLASS_BITS) if isinstance(codes, Column) else codes >> 2 * CLASS_BITS
    return context % _PRIME % buckets


def numbered_blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of a partition, in parts of about ``PART_BYTES``, with the number of their block: the same for any size of batches."""
    release()
    part, size = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        sizes = np.array([0 if n is None else n for n in pc.binary_length(text.cast(pa.large_binary())).to_pylist()], np.int64)
        before = size + np.cumsum(sizes) - sizes
        size += int(sizes.sum())
        number = before // BLOCK_BYTES
        new = (np.diff(number) != 0) | (np.diff(before // PART_BYTES) != 0)
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            yield part + int(number[a]), batch.slice(a, b - a)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(at, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """Sorted codes, and their counts if wanted, compressed: all first bytes, then all second ones, and so on."""
    both = np.concatenate(arrays).astype("<i8")
    return pa.compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, size: int, arrays: int = 2) -> tuple[np.ndarray, np.ndarray]:
    by_place = np.frombuffer(pa.decompress(packed, 8 * size * arrays, codec="zstd"), np.uint8).reshape(8, -1)
    both = np.ascontiguousarray(by_place.T).view("<i8").reshape(-1)
    return both[:size], both[size:]


def block_grams(docs: DataFrame, buckets: int) -> DataFrame:
    """(block, lang, bucket, size, grams): the n-grams of each block by language and bucket, from (text, lang).

    ``grams`` holds a sorted array of ``size`` codes and one of their counts.
    """

    def rows(block: int, found: dict[str, list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for lang, parts in found.items():
            codes, n = _merged(parts)
            bucket = bucket_of(codes, buckets)
            order = np.argsort(bucket, kind="stable")
            own, first = np.unique(bucket[order], return_index=True)
            some = np.split(order, first[1:])
            columns = [np.full(len(own), block), pa.array([lang] * len(own), pa.string()), own, np.array([len(x) for x in some]), pa.array([_packed(codes[x], n[x]) for x in some], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "lang", "bucket", "size", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        current = None
        for block, batch in numbered_blocks(batches):
            if block != current and found:
                yield from rows(current, found)
                found = {}
            current = block
            texts = [normal_form(t or b"") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            langs = batch.column("lang").to_pylist()
            for lang in dict.fromkeys(langs):
                parts = found.setdefault(OTHER if lang is None else lang, [])
                for _, _, codes in gram_codes([t for t, x in zip(texts, langs, strict=True) if x == lang and t]):
                    parts.append(np.unique(codes, return_counts=True))
                if not parts:
                    del found[OTHER if lang is None else lang]
                elif len(parts) > 16:
                    parts[:] = [_merged(parts)]
        if found:
            yield from rows(current, found)

    return docs.mapInArrow(run, "block long, lang string, bucket long, size long, grams binary")


def total_grams(grams: DataFrame) -> DataFrame:
    """(lang, code, n): the n-grams of all blocks, added up bucket by bucket."""

    def add_up(rows: pa.Table) -> pa.Table:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for lang, size, packed in zip(rows["lang"].to_pylist(), rows["size"].to_pylist(), rows["grams"].to_pylist(), strict=True):
            parts = found.setdefault(lang, [])
            parts.append(_unpacked(packed, size))
            if len(parts) > 64:
                parts[:] = [_merged(parts)]
        out = [(lang, *_merged(parts)) for lang, parts in found.items()]
        langs = pa.array([lang for lang, codes, _ in out for _ in range(len(codes))], pa.string())
        codes, n = (np.concatenate([x[k] for x in out]) for k in (1, 2))
        return pa.table({"lang": langs, "code": codes, "n": n})

    return grams.groupBy("bucket").applyInArrow(add_up, "lang string, code long, n long")


def _small(df: DataFrame) -> DataFrame:
    """A table of a row for each model, sent to every task unless languages are so many that it is joined."""
    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= SENT_MODELS else df


def _rest(order: int) -> Column:
    """The code of a code's last ``order`` characters."""
    return F.col("code").bitwiseAND(F.lit((1 << CLASS_BITS * order) - 1))


def _discounts(counts: DataFrame) -> DataFrame:
    """(model, d1, d2, d3): modified Kneser-Ney discounts from how many n-grams occur once to four times (none: as if one did)."""
    n1, n2, n3, n4 = (F.greatest(F.count_if(F.col("n") == k), F.lit(1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    raw = [k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}") for k in (1, 2, 3)]
    return counts.groupBy("model").agg(n1, n2, n3, n4).select("model", *[F.greatest(F.lit(0.05 * k), F.least(F.lit(0.95 * k), d)).alias(f"d{k}") for k, d in enumerate(raw, 1)])


def smoothed(counts: DataFrame) -> DataFrame:
    """(model, code, p): interpolated modified Kneser-Ney of n-gram counts (model, code, n) of the highest order.

    Orders below count the n-grams of the order above that they end; the lowest adds a half to each. A context
    has at most as many n-grams as there are characters' codes, which bounds the groups.
    """
    levels = [counts]
    for order in range(ORDER - 1, 0, -1):
        levels.append(checkpointed(levels[-1].groupBy("model", _rest(order).alias("code")).agg(F.count("*").alias("n"))))
    lowest = levels.pop()
    total = _small(lowest.groupBy("model").agg(F.sum(F.col("n") + 0.5).alias("total")))
    p = lowest.join(total, "model").select("model", "code", ((F.col("n") + 0.5) / F.col("total")).alias("p"))
    for order in range(2, ORDER + 1):
        own = levels.pop()
        context = Window.partitionBy("model", F.shiftright("code", CLASS_BITS))
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = own.join(_small(_discounts(own)), "model").select("model", "code", "n", d.alias("d"), _rest(order - 1).alias("low"))
        level = level.select("model", "code", "low", (F.col("n") - F.col("d")).alias("rest"), F.sum("n").over(context).alias("total"), F.sum("d").over(context).alias("taken"))
        lower = p.select("model", F.col("code").alias("low"), F.col("p").alias("lower"))
        p = level.join(lower, ["model", "low"]).select("model", "code", ((F.col("rest") + F.col("taken") * F.col("lower")) / F.col("total")).alias("p"))
    return p


def block_log_probabilities(docs: DataFrame) -> DataFrame:
    """(block, lang, size, codes, values): for each block of ``docs`` (text, lang) its n-grams and their log probabilities.

    A language's model counts as many n-grams as it has beside ``PRIOR_GRAMS`` for the model of all languages.
    There are as many buckets as shuffle partitions, so that a bucket's rows stay as small as a partition's.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grams = checkpointed(block_grams(docs.select("text", "lang"), buckets).repartition(buckets, "bucket"))
    own = checkpointed(total_grams(grams).select(F.concat(F.lit("="), "lang").alias("model"), "code", "n"))
    every = own.groupBy("code").agg(F.sum("n").alias("n")).select(F.lit(EVERY).alias("model"), "code", "n")
    p = smoothed(own.unionByName(every))
    pooled = F.max(F.when(F.col("model") == EVERY, F.col("p"))).over(Window.partitionBy("code"))
    size = _small(own.groupBy("model").agg(F.sum("n").cast("double").alias("size")))
    weight = F.col("size") / (F.col("size") + PRIOR_GRAMS)
    mixed = p.withColumn("q", pooled).join(size, "model").select("model", "code", F.log(weight * F.col("p") + (1 - weight) * F.col("q")).alias("value"))
    model = mixed.select(bucket_of(F.col("code"), buckets).alias("bucket"), F.substring("model", 2, 1 << 30).alias("lang"), "code", "value")

    def look_up(rows: pa.Table, known: pa.Table) -> pa.Table:
        langs = known["lang"].combine_chunks().dictionary_encode()
        codes, values, tables = known["code"].to_numpy(), known["value"].to_numpy(), {}
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            mine = np.flatnonzero(langs.indices.to_numpy() == k)
            mine = mine[np.argsort(codes[mine])]
            tables[lang] = codes[mine], values[mine]
        found, own_codes = [], []
        for lang, size, packed in zip(rows["lang"].to_pylist(), rows["size"].to_pylist(), rows["grams"].to_pylist(), strict=True):
            keys, own_values = tables[lang]
            mine, _ = _unpacked(packed, size)
            own_codes.append(_packed(mine))
            found.append(own_values[np.searchsorted(keys, mine)].astype("<f4").tobytes())
        return pa.table([rows[c] for c in ("block", "lang", "size")] + [pa.array(own_codes, pa.binary()), pa.array(found, pa.binary())], ["block", "lang", "size", "codes", "values"])

    rows = grams.select(F.col("bucket").alias("at"), *[F.col(c).alias(c) for c in ("block", "lang", "size", "grams")])
    return rows.groupBy("at").cogroup(model.groupBy("bucket")).applyInArrow(look_up, "block long, lang string, size long, codes binary, values binary")


class BlockModel:
    """The n-grams of one block by language, in sorted arrays."""

    def __init__(self, rows: pa.Table) -> None:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for row in rows.to_pylist():
            codes, _ = _unpacked(row["codes"], row["size"], 1)
            found.setdefault(row["lang"], []).append((codes, np.frombuffer(row["values"], "<f4").astype(float)))
        self.tables = {}
        for lang, parts in found.items():
            codes, values = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            order = np.argsort(codes)
            self.tables[lang] = codes[order], values[order]

    def log_probabilities(self, texts: list[bytes], langs: list[str | None]) -> np.ndarray:
        """The log probability of each text; 0 without words."""
        out = np.zeros(len(texts))
        for lang in dict.fromkeys(langs):
            mine = [i for i, x in enumerate(langs) if x == lang]
            normal = [(i, t) for i, t in ((i, normal_form(texts[i])) for i in mine) if t]
            if not normal:
                continue
            keys, values = self.tables[OTHER if lang is None else lang]
            index = np.array([i for i, _ in normal])
            for first, ends, codes in gram_codes([t for _, t in normal]):
                total = np.concatenate([[0.0], np.cumsum(values[np.searchsorted(keys, codes)])])
                out[index[first : first + len(ends)]] += np.diff(total[ends], prepend=0.0)
        return out
