"""Vectors for documents that lack one, in a run that gives up when the model does and can go on later."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.text import embed_text
from newsloom.operators.articles import since
from newsloom.operators.tables import checkpointed

SIZE, MOST_FAILURES = 64, 10
#: Documents of the first wave and of the largest: waves double, so a model that is down is noticed early.
WAVE, LARGEST = 1024, 1 << 20
_VECTORS, _DONE = "kind string, id long, embedding array<float>, run int, kind_no int, wave int", "at long, kind string, id long, embedding array<float>, error string, tried boolean"


@dataclass(frozen=True)
class EmbedResult:
    embedded: int
    failed: int
    stopped: bool


def embed_candidates(notes: DataFrame, articles: DataFrame, as_of: Column, days: int = 365) -> DataFrame:
    """(kind, id, text) of all notes (id, title, content) and of the articles of the last ``days`` that aren't archived."""
    recent = articles.where((F.col("status") != "archived") & since("fetched_at", as_of, days))
    own = notes.select(F.lit("note").alias("kind"), "id", embed_text(F.col("title"), F.col("content")).alias("text"))
    return own.unionByName(recent.select(F.lit("article").alias("kind"), "id", embed_text(F.col("title"), F.col("content_md")).alias("text")))


def read_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, id, embedding, run) of what runs have stored in ``folder``; empty before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/vectors")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "kind string, id long, embedding array<float>, run int")
    return spark.read.schema(_VECTORS).parquet(f"{folder}/vectors").select("kind", "id", "embedding", "run")


def _attempts(fn: Callable[[pd.Series], list], size: int, most: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Calls ``fn`` on ``size`` texts at a time, and if that fails one by one; after ``most`` failures in a row nothing more is tried."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        streak = 0

        def attempt(some: pd.DataFrame) -> pd.DataFrame:
            nonlocal streak
            if streak >= most:
                return some.assign(embedding=None, error=None, tried=False)
            try:
                out = some.assign(embedding=list(fn(some["text"])), error=None, tried=True)
                streak = 0
                return out
            except Exception as e:  # noqa: BLE001  the user's function may fail in any way
                if len(some) > 1:
                    return pd.concat([attempt(some.iloc[i : i + 1]) for i in range(len(some))])
                streak += 1
                return some.assign(embedding=None, error=str(e) or type(e).__name__, tried=True)

        for frame in frames:
            for i in range(0, len(frame), size):
                yield attempt(frame.iloc[i : i + size])[["at", "kind", "id", "embedding", "error", "tried"]]

    return run


def _streaks(done: DataFrame, before: int, most: int) -> tuple[int | None, int]:
    """(where the ``most``-th failure in a row stands, failures at the end) of a wave, when ``before`` failures came just before it.

    One task numbers a wave's rows, which are at most ``LARGEST`` numbers and flags.
    """
    alone = Window.orderBy("at")
    numbered = done.select("at", (~F.col("tried") | F.col("error").isNotNull()).alias("bad")).withColumn("n", F.row_number().over(alone))
    runs = numbered.where("bad").withColumn("run", F.col("n") - F.row_number().over(alone))
    streak = F.row_number().over(Window.partitionBy("run").orderBy("n")) + F.when(F.col("run") == 0, before).otherwise(0)
    long = runs.withColumn("streak", streak)
    row = long.agg(F.min(F.when(F.col("streak") >= most, F.col("at"))).alias("stop"), F.max_by("streak", "n").alias("last"), F.max("n").alias("n")).first()
    return row["stop"], row["last"] if row["n"] is not None and row["n"] == done.count() else 0


def embed_missing(docs: DataFrame, fn: Callable[[pd.Series], list], folder: str, run: int, *, size: int = SIZE, most_failures: int = MOST_FAILURES, wave: int = WAVE, largest: int = LARGEST) -> EmbedResult:
    """Stores vectors of the documents (kind, id, text) that have none in ``folder`` yet, notes before articles, each by id.

    Documents are taken in waves, in parallel within a wave. ``most_failures`` failures in a row, in the order of documents and over all
    tasks, stop the run: what stands behind is left as it is, as if one document had been asked after the other. Failures are
    counted by document, as a batch that fails is tried one by one, and a document that failed is tried again in the next run.
    Runs are numbered by the caller; one that is started again under its number goes on with what isn't stored.
    """
    spark, embedded, failed = docs.sparkSession, 0, 0
    for number, kind in enumerate(("note", "article")):
        left = docs.where(F.col("kind") == kind).join(read_vectors(spark, folder).select("kind", "id"), ["kind", "id"], "left_anti")
        ordered = checkpointed(left.select("kind", "id", "text").repartitionByRange("id").sortWithinPartitions("id").withColumn("at", F.monotonically_increasing_id()))
        # rows of each partition: a wave is a stretch of them, and a range of ``at``
        parts = sorted((r[0], r[1]) for r in ordered.groupBy(F.shiftright("at", 33).alias("p")).count().collect())
        ends = list(accumulate(n for _, n in parts))
        total = ends[-1] if ends else 0

        def place(row: int) -> int:
            i = bisect_right(ends, row)
            return (parts[i][0] << 33) + row - (ends[i - 1] if i else 0) if i < len(parts) else 1 << 62

        at, rows, streak, count = 0, wave, 0, 0
        while at < total:
            some = ordered.where((F.col("at") >= place(at)) & (F.col("at") < place(min(total, at + rows))))
            done = checkpointed(some.repartitionByRange("at").sortWithinPartitions("at").mapInPandas(_attempts(fn, size, most_failures), _DONE))
            stop, streak = _streaks(done, streak, most_failures)
            kept = done if stop is None else done.where(F.col("at") <= stop)
            good = kept.where("error IS NULL AND tried")
            good.select("kind", "id", "embedding").write.mode("append").parquet(f"{folder}/vectors/run={run}/kind_no={number}/wave={count}")
            counts = kept.agg(F.count_if(F.col("error").isNull() & F.col("tried")), F.count_if(F.col("error").isNotNull())).first()
            embedded, failed = embedded + counts[0], failed + counts[1]
            if stop is not None:
                return EmbedResult(embedded, failed, True)
            at, rows, count = at + rows, min(2 * rows, largest), count + 1
    return EmbedResult(embedded, failed, False)
