"""Upserts and update joins over immutable tables: they return the new table, to be written to a new path."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows of both tables by key. Incoming values win, but for columns in ``keep``, of which the stored value stays. Keys are unique on either side."""
    s, i = stored.alias("s").withColumn("_s", F.lit(True)), incoming.alias("i").withColumn("_i", F.lit(True))
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"i.{k}")) for k in keys]
    both = s.join(i, on, "full_outer")

    def value(c: str) -> Column:
        if c not in incoming.columns or c in keep:
            new = F.col(f"i.{c}") if c in incoming.columns else F.lit(None)
            return F.when(F.col("_s"), F.col(f"s.{c}")).otherwise(new)
        return F.when(F.col("_i"), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}"))

    return both.select(*[value(c).alias(c) for c in stored.columns], F.col("_s").isNull().alias("created"))


def apply_changes(table: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``table`` with the non-null values of a change table that has one row a key and some of its columns."""
    own = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in own])
    return table.join(new, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in own else F.col(c) for c in table.columns])


def last_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of each key in the given order."""
    at = Window.partitionBy(*keys).orderBy(*[o.desc_nulls_last() for o in order])
    return df.withColumn("_n", F.row_number().over(at)).where("_n = 1").drop("_n")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; in local mode, unset, a new one."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        folder = tempfile.mkdtemp(prefix="newsloom-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, name: str, after: int, *order: str) -> DataFrame:
    """``df`` with ``name``: numbers from ``after`` + 1 on, in the given order. No task orders all rows: each numbers a range of them.

    The driver sees one count a partition.
    """
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = sorted((r[0], r[1]) for r in placed.groupBy(F.shiftright("_at", 33).alias("p")).count().collect())
    before, starts = after + 1, []
    for part, count in counts:
        starts.append((part, before))
        before += count
    first = F.broadcast(df.sparkSession.createDataFrame(starts, "_p long, _first long"))
    own = placed.join(first, F.shiftright("_at", 33) == F.col("_p"))
    return own.withColumn(name, F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_p", "_first")


def numbered_within(df: DataFrame, key: str, name: str, *order: str) -> DataFrame:
    """``df`` with ``name``: numbers from 1 on within each ``key``, in the given order. A frequent key is as many ranges as it needs.

    What a range adds to a key's number comes from one row a key and range.
    """
    at = F.monotonically_increasing_id()
    placed = checkpointed(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_at", at)).withColumn("_p", F.shiftright("_at", 33))
    runs = placed.groupBy(key, "_p").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(runs.withColumn("_before", before).drop("_n"), [key, "_p"]).withColumn(name, F.col("_at") - F.col("_first") + F.col("_before") + 1).select(*df.columns, name)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: cut from its lineage, and with the size that it has.

    A checkpoint keeps the size that was estimated for its plan, which joins multiply: over many steps planning itself gets slow.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_blocks(x: DataFrame, y: DataFrame, key: str, x_id: str, y_id: str, most: int = 2000) -> tuple[DataFrame, DataFrame, list[str]]:
    """``x`` and ``y`` with the columns to join them on, ``key`` and those of a cell, so that no task holds all pairs of a frequent key.

    Rows of a key that has over ``most`` on a side are dealt to blocks by their ids, and every block of ``x`` meets every block of ``y`` in a cell of
    its own. Other keys are one cell. Each pair meets once.
    """
    often = [df.groupBy(key).agg(F.ceil(F.count("*") / most).alias(name)) for df, name in ((x, "_mx"), (y, "_my"))]
    hot = stored(often[0].join(often[1], key).where("_mx > 1 OR _my > 1"))

    def dealt(df: DataFrame, row: str, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64(row), F.coalesce(own[0], F.lit(1))).alias(own[1])
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(other[0], F.lit(1)) - 1)).alias(other[1])
        return df.join(hot, key, "left").select(*df.columns, block, every)

    sides = ("_mx", "_bx"), ("_my", "_by")
    return dealt(x, x_id, *sides), dealt(y, y_id, *sides[::-1]), [key, "_bx", "_by"]
