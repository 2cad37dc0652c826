"""Exact top-k by inner product through distributed histogram selection.

Blocks of queries meet stripes of vectors on a grid and all scores are computed as matrix products. The first
passes only count: each query has a range that surely holds its kth best score, cells count the scores in
equal bins of that range, the counts are added up, and the bin that holds the kth becomes the next range. Once
few scores are left in a range, it is final. A range of a single score that many candidates share (copies of a
vector) is refined by the same counts over their ids, smallest first. The last pass hands on what lies above a
query's range, and what is in it, to be ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed, table
from newsloom.operators.grid import on_grid

K, SCALE, BINS = 10, 1024, 256
#: A range with so many candidates is final; rows of a matrix of scores.
FEW, SLICE = 64, 2048


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False))), F.lit(False))


def length_limit(vectors: DataFrame, column: str) -> float:
    """At least the square of the longest vector's length; 0 without vectors."""
    square = F.aggregate(column, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.select(F.max(square)).first()[0] or 0.0


def matrix(column: pa.ChunkedArray | pa.Array, size: int, kind: type) -> np.ndarray:
    """Vectors of one size as rows."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), size)


class _Asked:
    """A block of queries with their ranges, by the size of their vectors."""

    def __init__(self, block: pa.Table, kind: type):
        self.kind, self.by_size = kind, {}
        sizes = block.column("size").to_numpy()
        for size in np.unique(sizes).tolist():
            own = block.filter(pa.array(sizes == size))
            self.by_size[size] = (*[own.column(c).to_numpy() for c in ("q", "floor", "lo", "hi", "need", "by_id")], matrix(own.column("v"), size, kind))

    def scored(self, batches: Iterator[pa.RecordBatch]):
        """(query columns, row keys, id keys, scores with a column for each query) of every slice of the rows."""
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size, own in self.by_size.items():
                rows = batch.filter(pa.array(sizes == size))
                for at in range(0, rows.num_rows, SLICE):
                    some = rows.slice(at, SLICE)
                    scores = (matrix(some.column("v"), size, self.kind) @ own[-1].T).astype(np.int64)
                    yield own[:-1], some, scores, some.column("r").to_numpy()[:, None] == own[0][None, :]


def _keys(some: pa.RecordBatch) -> np.ndarray:
    """Ids as keys of which the largest come first: null ids are last."""
    return ~some.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()


def _counts(kind: type, bins: int):
    """Cells that count, for each query, the candidates in each bin of its range."""

    def cell(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, totals = _Asked(block, kind), {}
        for (q, floor, lo, hi, need, by_id), some, scores, own in asked.scored(batches):
            values = np.where(by_id, _keys(some)[:, None], scores)
            inside = (values >= lo) & (values <= hi) & ~own & (~by_id | (scores == floor))
            low = lo.view(np.uint64)
            width = (hi.view(np.uint64) - low) // np.uint64(bins) + np.uint64(1)
            row, column = np.nonzero(inside)
            place = ((values[row, column].view(np.uint64) - low[column]) // width[column]).astype(np.int64)
            size = len(some.column("v")[0])
            if size not in totals:
                totals[size] = [np.zeros(len(q) * bins, np.int64), q, lo, hi, need, width]
            totals[size][0] += np.bincount(column * bins + place, minlength=len(q) * bins)
        for total, q, lo, hi, need, width in totals.values():
            at = np.flatnonzero(total)
            column, place = at // bins, (at % bins).astype(np.uint64)
            first = (lo.view(np.uint64)[column] + place * width[column]).view(np.int64)
            room = hi.view(np.uint64)[column] - first.view(np.uint64)
            last = (first.view(np.uint64) + np.minimum(room, width[column] - np.uint64(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(q[column]), pa.array(need[column]), pa.array(first), pa.array(last), pa.array(total[at])], ["q", "need", "first", "last", "n"])

    return cell


def _chosen(kind: type):
    """Cells that hand on, for each query, what lies above its range or in it; of rows equal in score and id no more than it needs."""

    def cell(block: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(block, kind)
        for (q, floor, lo, hi, need, by_id), some, scores, own in asked.scored(batches):
            keys = _keys(some)[:, None]
            in_range = np.where(by_id, (scores == floor) & (keys >= lo), scores >= lo)
            same = by_id & (lo == hi) & (scores == floor) & (keys == lo) & ~own
            if same.any():
                in_range &= ~same | (np.cumsum(same, axis=0) <= need)
            row, column = np.nonzero((in_range | by_id & (scores > floor)) & ~own)
            yield pa.RecordBatch.from_arrays([pa.array(q[column]), some.column("id").take(pa.array(row)), pa.array(scores[row, column])], ["q", "id", "score"])

    return cell


def top_inner_products(vectors: DataFrame, queries: Column, key: str = "vec_id", column: str = "embedding", k: int = K, scale: int = SCALE, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for each row for which ``queries`` holds.

    Scores are inner products of the vectors' integers floor(scale * x); ties go to the smaller key, null keys
    come last. A query's own row, and it alone, is no candidate, so repeated rows find each other. Vectors that are null or hold
    null or non-finite components take no part; vectors of another size than a query's are no candidates of it. Fewer than ``k``
    candidates are all returned; a query without any, and an empty table, give no row. Scores that a long can't hold are
    an error, as in Spark's own sums. Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = checkpointed(vectors.where(usable(F.col(column))).select(F.monotonically_increasing_id().alias("r"), F.col(key).cast("long").alias("id"), F.size(column).alias("size"), integers(F.col(column), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asked")))
    limit = length_limit(rows, "v")
    if limit >= 2.0**62:
        raise ArithmeticError("scores of these vectors exceed a long")
    kind = np.float64 if limit < 2.0**52 else np.int64
    bound = int(limit * 1.001) + 1
    least, most = rows.select(F.min(F.bitwise_not(F.coalesce("id", F.lit((1 << 63) - 1)))), F.max(F.bitwise_not(F.coalesce("id", F.lit((1 << 63) - 1))))).first()
    candidates = rows.select("r", "id", "size", "v")
    of_size = rows.groupBy("size").agg(F.count("*").alias("others"))
    asked = rows.where("asked").join(F.broadcast(of_size) if of_size.count() <= 10_000 else of_size, "size").where("others > 1")
    state = checkpointed(asked.select(F.col("r").alias("q"), F.col("id").alias("query_id"), "size", "v", F.lit(0).cast("long").alias("floor"), F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"), F.least(F.lit(k).cast("long"), F.col("others") - 1).alias("need"), F.lit(False).alias("by_id"), (F.col("others") - 1).alias("n")))
    own = ["q", "size", "v", "floor", "lo", "hi", "need", "by_id"]
    final, open_ = [], state
    while True:
        wide = (F.col("n") > few) & ((F.col("lo") < F.col("hi")) | ~F.col("by_id"))
        final.append(open_.where(~wide))
        # many candidates of one score: their ids are the next range
        single = ~F.col("by_id") & (F.col("lo") == F.col("hi"))
        open_ = open_.where(wide).withColumns({"floor": F.when(single, F.col("lo")).otherwise(F.col("floor")), "lo": F.when(single, F.lit(least).cast("long")).otherwise(F.col("lo")), "hi": F.when(single, F.lit(most).cast("long")).otherwise(F.col("hi")), "by_id": F.col("by_id") | single})
        if open_.isEmpty():
            break
        counted = on_grid(open_.select(*own), candidates, _counts(kind, bins), "q long, need long, first long, last long, n long")
        summed = counted.groupBy("q", "need", "first", "last").agg(F.sum("n").alias("held"))
        above = F.coalesce(F.sum("held").over(Window.partitionBy("q").orderBy(F.desc("first")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = summed.withColumn("above", above).where("above < need AND above + held >= need")
        # a union and not a join: a plan's estimated size would be multiplied in every round
        sides = open_.select("q", F.struct("query_id", "size", "v", "floor", "by_id").alias("s"), F.lit(None).cast("struct<lo: long, hi: long, need: long, n: long>").alias("f"))
        sides = sides.unionByName(found.select("q", F.lit(None).cast(sides.schema["s"].dataType).alias("s"), F.struct(F.col("first").alias("lo"), F.col("last").alias("hi"), (F.col("need") - F.col("above")).alias("need"), F.col("held").alias("n")).alias("f")))
        open_ = checkpointed(sides.groupBy("q").agg(F.first("s", True).alias("s"), F.first("f", True).alias("f")).select("q", "s.*", "f.*"))
    settled = final[0]
    for some in final[1:]:
        settled = settled.unionByName(some)
    settled = checkpointed(settled)
    best = on_grid(settled.select(*own), candidates, _chosen(kind), "q long, id long, score long")
    at = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = best.withColumn("rank", F.row_number().over(at)).where(F.col("rank") <= k)
    return ranked.join(settled.select("q", "query_id"), "q").select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


OP13_SQL = f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.r AS q, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM kept q JOIN kept c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id ASC NULLS LAST) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {K}
"""
