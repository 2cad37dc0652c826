"""Near-duplicate documents by SimHash and multi-index hashing.

A fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most three bits differ in
at most one bit of some segment, so each fingerprint is filed under its segments, and looked up under its
segments and all their neighbours at distance one; as links have no direction, only neighbours that set a
bit are needed. Fingerprints that meet under a key are verified over all 64 bits. Copies share a fingerprint
and are one row throughout. The distinct fingerprints under one key differ in the other segment alone, which
bounds them by geometry, not by the number of copies; keys with more than ``BLOCK`` are compared block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import checkpointed, table, text_bytes, unused, with_arrow_columns
from newsloom.llm.components import connected_components

SHINGLE, SEED, DISTANCE, BLOCK = 3, 42, 3, 256
#: Components of so many roots are named by sending out their least keys; more are joined.
SENT_ROOTS = 200_000


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash over word shingles, repeats included; no word: zero."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - size + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 14):
        bits = np.unpackbits(hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int32)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > n).tolist()))


def with_fingerprint(docs: DataFrame, column: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` without its text, with the fingerprint as a signed long. Null and blank texts: 0."""

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            return [np.array([fingerprint(t) for t in text_bytes(batch, column)], np.uint64).view(np.int64)]

        return compute

    return with_arrow_columns(docs, [T.StructField(name, T.LongType())], make, drop=(column,))


def _segments() -> Column:
    """Keys of ``fp`` as structs: the key (segment number above its 32 bits) and whether it is the fingerprint's own."""

    def keys(number: int, value: Column) -> Column:
        tag = F.lit(number << 32)
        clear = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.getbit(value, i) == 0)
        near = F.transform(clear, lambda i: F.struct((value + F.call_function("shiftleft", F.lit(1).cast("long"), i) + tag).alias("key"), F.lit(False).alias("own")))
        return F.concat(F.array(F.struct((value + tag).alias("key"), F.lit(True).alias("own"))), near)

    return F.concat(keys(0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))), keys(1, F.shiftrightunsigned("fp", 32)))


def _local_links(groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups: from each fingerprint that has one to the first of its group that it reaches inside the group."""
    left, right = [], []
    sizes = np.array([len(g) for g in groups])
    for n in np.unique(sizes).tolist():
        own = np.stack([groups[i] for i in np.flatnonzero(sizes == n)]).view(np.uint64)
        for some in np.array_split(own, max(1, len(own) * n * n >> 20)):
            near = np.bitwise_count(some[:, :, None] ^ some[:, None, :]) <= DISTANCE
            root = np.broadcast_to(np.arange(n), some.shape).copy()
            while True:
                new = np.where(near, root[:, None, :], n).min(2)
                if (new == root).all():
                    break
                root = new
            g, i = np.nonzero(root != np.arange(n))
            left.append(some[g, i])
            right.append(some[g, root[g, i]])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left).view(np.int64), np.concatenate(right).view(np.int64)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp``: links at ``DISTANCE`` or fewer bits that connect all that such links connect.

    Within each group that meets under a key only a spanning set of links is kept, so their number grows with
    the fingerprints and not with the pairs.
    """
    keyed = fps.select("fp", F.explode(_segments()).alias("k")).select("fp", "k.*")
    at = Window.partitionBy("key")
    met = keyed.select("fp", "key", F.count("*").over(at).alias("n"), F.max("own").over(at).alias("filed")).where("n > 1 AND filed")
    blocks = F.ceil(F.col("n") / BLOCK)
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), blocks)
    pairs = met.select("key", "fp", mine.alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j"))
    groups = pairs.groupBy("key", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.collect_list("fp").alias("fps"))

    def link(batches):
        for batch in batches:
            column = batch.column("fps")
            values, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            groups = [np.sort(values[a - at[0] : b - at[0]].view(np.uint64)).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]
            a, b = _local_links([g for g in groups if len(g) > 1])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return groups.select("fps").mapInArrow(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, column: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (16 hex digits) and ``component_id``, the smallest key reachable.

    Documents are linked if their fingerprints differ in at most ``DISTANCE`` bits. Null, empty and blank
    texts have fingerprint zero and are linked like any other; texts of fewer words than a shingle hash
    as a whole; repeated rows share a component. A null key takes part and is never the smallest, unless
    all keys of the component are null: then component_id is null. An empty table gives an empty result.
    """
    kept = [c for c in docs.columns if c != column and c.lower() not in ("fingerprint", "component_id")]
    fp, known, root_, least_ = unused(docs.columns, "_fp", "_known", "_root", "_least")
    prints = checkpointed(with_fingerprint(docs.select(*kept, *([] if column in kept else [column])), column, fp))
    distinct = prints.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias(least_))
    roots = connected_components(fingerprint_links(distinct.select("fp"))).select("node", F.col("root").alias(root_))
    member = checkpointed(distinct.join(roots, F.col("fp") == F.col("node"), "left").drop("node"))
    # a fingerprint without a link is its own component; those of large components meet their least key where it is sent
    linked = member.where(F.col(root_).isNotNull())
    least = checkpointed(linked.groupBy(root_).agg(F.min(least_).alias("component_id")))
    side = F.broadcast(least) if least.count() <= SENT_ROOTS else least
    alone = member.where(F.col(root_).isNull()).select(F.col("fp").alias(known), F.col(least_).alias("component_id"))
    named = alone.unionByName(linked.join(side, root_).select(F.col("fp").alias(known), "component_id"))
    out = prints.join(named, F.col(fp) == F.col(known))
    return out.select(*kept, F.lpad(F.lower(F.hex(fp)), 16, "0").alias("fingerprint"), "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")
