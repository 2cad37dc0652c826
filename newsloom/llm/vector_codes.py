"""Vector codes by product quantization, with Orchard's search for the nearest codebook entry.

Every entry of a codebook has the list of all others, sorted by their distance to it. A search holds a current entry
and goes along its list: an entry not yet visited is compared, one that is nearer becomes the current one
and its list is taken up, and the search ends once the list is beyond twice the current distance, since nothing
there can be as near. Distances are whole numbers, so the ends of lists and ties are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import checkpointed, release, table, unused
from newsloom.llm.top_k import SCALE, integers, length_limit, usable

PARTS, ENTRIES, ROUNDS = 4, 256, 4
#: Points that are searched side by side, and entries of a list that a step takes at a time.
POINTS, RUN = 4096, 12
#: Labels that have one of so many rows are sent out, as there are no more of them than that; others are joined.
HEAVY = 10_000


class Orchard:
    """Codebook entries (rows of whole numbers) with their sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries, k = entries, len(entries)
        gaps = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        alone = np.where(np.eye(k, dtype=bool), -1, gaps)
        self.order = np.argsort(alone, axis=1, kind="stable")[:, 1:]
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each point; ties go to the lower index."""
        index, distance = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        for at in range(0, len(points), POINTS):
            index[at : at + POINTS], distance[at : at + POINTS] = self._search(points[at : at + POINTS])
        return index, distance

    def _search(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, k = len(points), len(self.entries)
        current, distance = np.zeros(n, np.int64), ((points - self.entries[0]) ** 2).sum(1)
        visited, place = np.zeros((n, k), bool), np.zeros(n, np.int64)
        visited[:, 0] = True
        live = np.arange(n if k > 1 else 0)
        while len(live):
            at, columns = current[live][:, None], place[live][:, None] + np.arange(RUN)
            inside, columns = columns < k - 1, np.minimum(columns, k - 2)
            entry = self.order[at, columns]
            reach = inside & (self.gaps[at, columns] <= 4 * distance[live][:, None])
            row, column = np.nonzero(reach & ~visited[live[:, None], entry])
            tried = entry[row, column]
            visited[live[row], tried] = True
            # distance and index as one number, so the least is the nearest entry of lowest index
            found = np.full(entry.shape, np.iinfo(np.int64).max)
            found[row, column] = ((points[live[row]] - self.entries[tried]) ** 2).sum(1) * k + tried
            least = found.min(1)
            better = least < distance[live] * k + current[live]
            jump = live[better]
            current[jump], distance[jump], place[jump] = least[better] % k, least[better] // k, 0
            place[live[~better]] += RUN
            live = live[better | reach.all(1)]
        return current, distance


def _cut(rows: np.ndarray, parts: int) -> list[np.ndarray]:
    """Consecutive parts, equal where ``parts`` divides the size."""
    size = rows.shape[1]
    return [rows[:, size * p // parts : size * (p + 1) // parts] for p in range(parts)]


def _whole(batch: pa.RecordBatch, column: str, size: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the vectors of a batch as rows."""
    values = batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(values * scale).astype(np.int64).reshape(batch.num_rows, size)


def _first(vectors: DataFrame, key: str, column: str, entries: int) -> list:
    """Vectors of the ``entries`` smallest keys; equal keys in the order of their vectors, null keys last."""
    order = F.asc_nulls_last(key)
    ids = checkpointed(vectors.select(key).orderBy(order).limit(entries))
    least = ids.select(F.max(key), F.count(key)).first()
    near = vectors.where(F.col(key) <= least[0]) if least[1] == entries else vectors
    return [r[0] for r in near.orderBy(order, column).limit(entries).select(column).collect()]


def fit_codebooks(vectors: DataFrame, key: str, column: str, size: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> list[np.ndarray]:
    """A codebook for each part of the integers of ``vectors`` (usable and of ``size``), after ``rounds`` rounds over all of them.

    A task hands on one sum a component of each entry, so what is shuffled grows with tasks and not with
    vectors, and the driver holds ``entries`` times ``size`` numbers.
    """
    first = _first(vectors, key, column, entries)
    start = np.floor(np.array(first, np.float64).reshape(len(first), size) * scale).astype(np.int64)
    books = [b.copy() for b in _cut(start, parts)]

    def totals(books: list[np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            release()
            searches = [Orchard(b) for b in books]
            sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
            for batch in batches:
                for search, own, total, count in zip(searches, _cut(_whole(batch, column, size, scale), parts), sums, counts, strict=True):
                    index, _ = search.nearest(own)
                    np.add.at(total, index, own)
                    count += np.bincount(index, minlength=len(count))
            for part, (total, count) in enumerate(zip(sums, counts, strict=True)):
                used = np.flatnonzero(count)
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

        return run

    for _ in range(rounds):
        tasks = vectors.select(column).mapInArrow(totals(books), "part int, entry int, n long, total array<long>")
        summed = tasks.select("part", "entry", "n", F.posexplode_outer("total").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        new = [b.copy() for b in books]
        for r in summed.collect():
            if r["place"] is not None:
                new[r["part"]][r["entry"], r["place"]] = r["x"] // r["n"]
        same = all((a == b).all() for a, b in zip(books, new, strict=True))
        books = new
        if same:  # further rounds would change nothing
            break
    return books


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], column: str, scale: int = SCALE) -> DataFrame:
    """``vectors`` without ``column``, with ``code`` (two hex digits a part) and ``error`` (squared distance to the entries named)."""
    kept = [c for c in vectors.columns if c != column and c.lower() not in ("code", "error")]
    size = sum(b.shape[1] for b in books)
    schema = vectors.select(*kept).schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        searches = [Orchard(b) for b in books]
        for batch in batches:
            found = [s.nearest(own) for s, own in zip(searches, _cut(_whole(batch, column, size, scale), len(books)), strict=True)]
            digits, step = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex(), 2 * len(books)
            codes = [digits[k : k + step] for k in range(0, len(digits), step)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(codes, pa.string()), pa.array(sum(d for _, d in found))], [*kept, "code", "error"])

    return vectors.select(*kept, column).mapInArrow(run, schema)


def _with_group_total(rows: DataFrame, label: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over equal labels, nulls together; a label of many rows isn't one task."""
    own, total, n = unused(rows.columns, "_label", "_total", "_n")
    sums = checkpointed(rows.groupBy(F.col(label).alias(own)).agg(F.sum(value).alias(total), F.count("*").alias(n)))
    heavy = F.col(n) * HEAVY >= (sums.select(F.sum(n)).first()[0] or 0)
    light, same = unused([*rows.columns, own, total, n], "_light", "_same")
    sent = rows.join(F.broadcast(sums.where(heavy)), F.col(label).eqNullSafe(F.col(own)), "left")
    done = sent.where(F.col(n).isNotNull()).select(*rows.columns, F.col(total).alias(name))
    other = sums.where(~heavy).select(F.col(own).alias(same), F.col(total).alias(light))
    return done.unionByName(sent.where(F.col(n).isNull()).join(other, F.col(label).eqNullSafe(F.col(same))).select(*rows.columns, F.col(light).alias(name)))


def vector_codes(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``vectors`` without ``column``, with ``code``, ``error``, ``label_error`` and ``codebooks_sha256``.

    Components become floor(scale * x). Vectors that are null or hold null or non-finite components are dropped, and so are those
    whose size isn't that of the smallest key's usable vector; sizes that ``parts`` doesn't divide are cut as evenly as
    they can be. Codebooks start with the ``entries`` (at most 256) smallest keys, all there are if fewer; of equal keys the
    smaller vector comes first, null keys come last. Repeated rows all count and are all returned; an empty table gives an empty
    result. Columns named like a new one are replaced. Distances times 256 that a long can't hold are an error, as in Spark's own
    sums. ``vectors`` is read once a round and twice more, so it should be files or a checkpoint.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries")
    good = vectors.where(usable(F.col(column)))
    one = _first(good, key, column, 1)
    size = len(one[0]) if one else 0
    good = good.where(F.size(column) == size)
    if length_limit(good.select(integers(F.col(column), scale).alias("v")), "v") >= 2.0**52:
        raise ArithmeticError("distances of these vectors exceed a long")
    books = fit_codebooks(good, key, column, size, parts, entries, rounds, scale) if one else _cut(np.zeros((1, 0), np.int64), parts)
    own = {"code", "error", "label_error", "codebooks_sha256"}
    kept = [c for c in vectors.columns if c != column and c.lower() not in own]
    coded = checkpointed(encode(good.select(*kept, *([column] if column not in kept else [])), books, column, scale))
    return _with_group_total(coded, label, "error", "label_error").withColumn("codebooks_sha256", F.lit(codebooks_sha256(books)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """Assignment and replacement, round by round, over every pair of a part and an entry."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT r, p, v[len(v) // {PARTS} * p + 1 : len(v) // {PARTS} * (p + 1)] AS x FROM kept, range({PARTS}) AS t(p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= {ENTRIES})",
    ]
    assign = "near{i} AS MATERIALIZED (SELECT r, p, min((list_inner_product(x, x) + list_inner_product(c, c) - 2 * list_inner_product(x, c)) * 256 + e) AS k FROM cut JOIN book{i} USING (p) GROUP BY r, p)"
    for i in range(ROUNDS):
        steps.append(assign.format(i=i))
        steps.append(f"sums{i} AS (SELECT p, CAST(k AS BIGINT) % 256 AS e, j, floor(sum(x[j + 1]) / count(*)) AS m FROM near{i} JOIN cut USING (r, p), range(1024) AS t(j) WHERE j < len(x) GROUP BY ALL)")
        steps.append(f"mean{i} AS (SELECT p, e, list(m ORDER BY j) AS c FROM sums{i} GROUP BY p, e)")
        steps.append(f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON b.p = m.p AND b.e = m.e)")
    steps.append(assign.format(i=ROUNDS))
    steps.append(f"codes AS (SELECT r, string_agg(printf('%02x', CAST(k AS BIGINT) % 256), '' ORDER BY p) AS code, CAST(sum(CAST(k AS BIGINT) // 256) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r)")
    steps.append(f"flat AS (SELECT p, e, unnest(c) AS x, unnest(range(len(c))) AS j FROM book{ROUNDS})")
    steps.append("sha AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS h FROM flat)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT h FROM sha) AS codebooks_sha256 FROM kept JOIN codes USING (r)"


OP11_SQL = _sql()
