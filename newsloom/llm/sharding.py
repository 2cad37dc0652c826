"""Shards by extendible hashing.

A document's address is a 60-bit hash of its key. The directory starts with one bucket; a bucket whose bytes
exceed the limit splits on the next address bit, and only such buckets split. Splitting bucket by bucket
leaves each document in the shortest prefix of its address whose bytes fit the limit, so a round sums bytes
under the next ``STEP`` bits of the buckets that are still too large and finds the split depth of all of them.
Rows that share all bits (repeated keys) overflow: the bucket is cut into pages of running byte totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed, table, unused

BITS, STEP, LIMIT = 60, 15, 16 << 20


def address(key: Column) -> Column:
    """The first 60 bits of the key's MD5 as a string of 0 and 1; a null key hashes as empty text."""
    digits = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 2)
    return F.lpad(digits, BITS, "0")


def assign_shards(rows: DataFrame, limit: int = LIMIT, key: str = "doc_id", size: str = "n_bytes") -> DataFrame:
    """``rows`` with ``shard`` (the address prefix of its bucket, empty for an unsplit directory), ``page`` and ``shard_bytes``.

    Every (shard, page) holds at most ``limit`` bytes, unless one row alone is larger: that row has a page of
    its own. ``page`` is 0 but in buckets whose rows all share the whole address. A null size counts as 0, a
    null key as an empty one; repeated rows are all kept; an empty table gives an empty result.
    """
    asked = [c for c in rows.columns if c.lower() not in ("shard", "page", "shard_bytes")]
    # columns that are named like one of this function's step aside meanwhile
    inner = {"_a", "_n", "_c", "_cell", "_bytes", "_part", "_b", "_k", "_b0", "_k0", "prefix", "d", "cell", "bytes", "p", "next"}
    aside = dict(zip((c for c in asked if c.lower() in inner), unused(list(rows.columns), *(f"_in_{c}" for c in asked if c.lower() in inner)), strict=True))
    rows, key, size = rows.select(*[F.col(c).alias(aside.get(c, c)) for c in rows.columns]), aside.get(key, key), aside.get(size, size)
    kept = [aside.get(c, c) for c in asked]
    back = [F.col(aside.get(c, c)).alias(c) for c in asked]
    own = checkpointed(rows.select(*kept, address(F.col(key)).alias("_a"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n")))
    spark, done = rows.sparkSession, None
    large = spark.sql("SELECT '' AS prefix")  # buckets that are to split, all of one length
    depth = 0
    while depth < BITS:
        after = depth + STEP
        at = own if depth == 0 else own.join(large, F.substring("_a", 1, depth) == large["prefix"], "left_semi")
        cells = checkpointed(at.groupBy(F.substring("_a", 1, after).alias("cell")).agg(F.sum("_n").alias("bytes")))
        levels = F.explode(F.sequence(F.lit(depth), F.lit(after))).alias("d")
        sums = cells.select("cell", "bytes", levels).groupBy(F.expr("substring(cell, 1, d)").alias("prefix"), "d").agg(F.sum("bytes").alias("bytes"))
        over = sums.where(F.col("bytes") > limit)
        # a bucket that fits (or has the last bit) below one that doesn't
        parent = over.select(F.col("prefix").alias("p"), (F.col("d") + 1).alias("next"))
        fits = sums.where(F.col("bytes") <= limit)
        leaves = fits.where(F.col("d") > depth).join(parent, (F.expr("substring(prefix, 1, d - 1)") == F.col("p")) & (F.col("d") == F.col("next")), "left_semi")
        leaves = leaves.unionByName(fits.where(F.col("d") == 0)) if depth == 0 else leaves
        if after == BITS:
            leaves = leaves.unionByName(over.where(F.col("d") == after))
        done = leaves if done is None else done.unionByName(leaves)
        large = checkpointed(over.where(F.col("d") == after).select("prefix"))
        depth = after
        if large.isEmpty():
            break
    directory = checkpointed(done.select(F.col("prefix").alias("shard"), "d", F.col("bytes").alias("_bytes")))
    depths = [r["d"] for r in directory.select("d").distinct().orderBy("d").collect()]  # at most BITS + 1
    candidates = F.array(*[F.substring("_a", 1, d) for d in depths]) if depths else F.array().cast("array<string>")
    # the leaf of a row is the one prefix of its address that is in the directory: found cell by cell, not row by row
    cell = F.substring("_a", 1, depth)
    cells = own.select(cell.alias("_cell"), candidates.alias("_c")).distinct()
    leaf = cells.select("_cell", F.explode("_c").alias("shard")).join(directory, "shard").select("_cell", "shard", "_bytes")
    placed = own.withColumn("_cell", cell).join(leaf, "_cell")
    result = placed.where((F.length("shard") < BITS) | (F.col("_bytes") <= limit))
    out = result.select(*kept, "shard", F.lit(0).alias("page"), F.col("_bytes").alias("shard_bytes"))
    if depth < BITS or large.isEmpty():
        return out.select(*back, "shard", "page", "shard_bytes")
    overflow = checkpointed(placed.where((F.length("shard") == BITS) & (F.col("_bytes") > limit)).withColumn("_part", F.spark_partition_id()))
    return out.unionByName(_pages(overflow, kept, limit)).select(*back, "shard", "page", "shard_bytes")


def _pages(rows: DataFrame, kept: list[str], limit: int) -> DataFrame:
    """Cuts buckets of equal addresses by running totals: a page number for each stretch of ``limit // 2`` bytes, rows over that alone.

    Totals run within a partition and over the totals of the partitions before it, so no bucket is one group.
    Rows of up to half the limit that start in the same stretch are a page of at most the limit.
    """
    half = max(1, limit // 2)
    small, big = F.col("_n") <= half, F.col("_n") > half
    parts = rows.groupBy("shard", "_part").agg(F.sum(F.when(small, F.col("_n")).otherwise(0)).alias("b"), F.sum(big.cast("long")).alias("k"))
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("shard", "_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_k0"))
    within = Window.partitionBy("shard", "_part").orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    running = rows.withColumn("_b", F.coalesce(F.sum(F.when(small, F.col("_n")).otherwise(0)).over(within), F.lit(0))).withColumn("_k", F.coalesce(F.sum(big.cast("long")).over(within), F.lit(0)))
    page = F.when(small, F.floor((F.col("_b0") + F.col("_b")) / half) * 2).otherwise((F.col("_k0") + F.col("_k")) * 2 + 1)
    paged = running.join(starts, ["shard", "_part"]).withColumn("page", page.cast("int"))
    sizes = paged.groupBy("shard", "page").agg(F.sum("_n").alias("shard_bytes"))
    return paged.join(sizes, ["shard", "page"]).select(*kept, "shard", "page", "shard_bytes")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", size: str = "n_bytes") -> None:
    """Writes documents that have ``shard`` and ``page`` as one folder for each of them, a single file in each."""
    docs.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return assign_shards(docs).select("doc_id", "n_bytes", "shard", "page", "shard_bytes")


#: The shard of a row is the shortest prefix of its address whose bytes fit the limit.
OP5_SQL = f"""
WITH hex AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
addr AS (SELECT doc_id, n_bytes, lpad(bin(CAST(concat('0x', substring(h, 1, 15)) AS BIGINT)), 60, '0') AS a FROM hex),
sums AS (SELECT substring(a, 1, d) AS shard, d, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM addr, range(0, 25) AS r(d) GROUP BY ALL),
least AS (SELECT a.doc_id, a.n_bytes, a.a, min(s.d) AS d FROM addr a JOIN sums s ON substring(a.a, 1, s.d) = s.shard WHERE s.shard_bytes <= {LIMIT} GROUP BY ALL)
SELECT l.doc_id, CAST(l.n_bytes AS BIGINT) AS n_bytes, s.shard, CAST(0 AS INTEGER) AS page, s.shard_bytes
FROM least l JOIN sums s ON s.shard = substring(l.a, 1, l.d)
"""
