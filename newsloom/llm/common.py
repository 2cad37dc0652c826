"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import re
import tempfile
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one step of a vectorised pass takes; its numpy arrays are a few dozen times as large.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the folder that ``spark.checkpoint.dir`` names; in local mode, unset, in a new one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="newsloom-"))
    return df.checkpoint()


def unused(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores before them as it takes to be none of ``columns``, in any case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


_HELD: dict[object, object] = {}


def held(key: object, make: Callable[[], Any]) -> Any:
    """What a worker process keeps from task to task, made when it isn't there; there is one such thing at a time."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Gives up what a worker process keeps, for the memory of tasks that don't need it."""
    if _HELD:
        _HELD.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def held_out(doc_id: Column) -> Column:
    """The fold that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def with_arrow_columns(df: DataFrame, fields: list[T.StructField], make: Callable[[], Callable[[pa.RecordBatch], list]], drop: tuple[str, ...] = (), holds: bool = False) -> DataFrame:
    """``df`` with the columns that a function computes from each Arrow batch.

    ``make()`` runs once in each task and returns that function. A column of ``df`` that is named like a new
    one is replaced; those in ``drop`` are read by the function and left out of the result. Unless ``make`` uses
    what a worker ``holds``, that is given up first.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and f.name not in drop]
    schema, names = T.StructType(kept + fields), [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            release()
        compute = make()
        for batch in batches:
            if batch.num_rows:
                made = [x if isinstance(x, pa.Array) else pa.array(x) for x in compute(batch)]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + made, names + [f.name for f in fields])

    return df.mapInArrow(run, schema)


def text_bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """All texts in runs of about ``limit`` bytes, with the index of the text that each belongs to.

    A longer text comes in pieces, cut before white space, or before a character where there is none.
    """
    owners: list[int] = []
    some: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text) or not at:
            end = len(text)
            if end - at > limit:
                end = max(text.rfind(b" ", at + 1, at + limit), text.rfind(b"\n", at + 1, at + limit))
                if end < 0:
                    end = at + limit
                    while text[end] & 0xC0 == 0x80 and end > at + 1:
                        end -= 1
            owners.append(i)
            some.append(text[at:end])
            size += end - at + 1
            at = max(end, 1)
            if size >= limit:
                yield np.array(owners), some
                owners, some, size = [], [], 0
    if owners:
        yield np.array(owners), some


def joined(texts: list[bytes], separator: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the texts with a separator before, between and after them, and where each starts and ends."""
    data = np.frombuffer(separator + separator.join(texts) + separator, np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return data, np.concatenate([[1], ends[:-1] + 1]), ends


def bounded_sample(df: DataFrame, label: str, content: str, per_label: int, labels: int, least: int = 50) -> DataFrame:
    """Distinct rows of every non-null label, about ``per_label`` of each.

    Of more than ``labels`` labels each has an equal share of ``labels`` times ``per_label`` rows, but not under
    ``least``. Rates come from the numbers of distinct rows, and a row is in by a hash of ``content``, so copies
    of a text are in or out together and count once. Labels with fewer distinct rows are whole.
    """
    known = df.where(F.col(label).isNotNull()).withColumn("_copy", F.xxhash64(content))
    counts = known.select(label, "_copy").distinct().groupBy(label).count().collect()
    share = per_label if len(counts) <= labels else min(per_label, max(least, per_label * labels // len(counts)))
    schema = T.StructType([df.schema[label], T.StructField("_rate", T.DoubleType())])
    rates = df.sparkSession.createDataFrame([(r[label], min(1.0, share / r["count"])) for r in counts], schema)
    draw = F.pmod(F.xxhash64(content, F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    drawn = known.join(F.broadcast(rates), label).where(draw < F.col("_rate"))
    return drawn.dropDuplicates([label, "_copy"]).select(*df.columns)
