"""Every row of one table against every row of another, in cells of bounded size, without the driver or a broadcast."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, groupby, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block of queries, which a task holds at once, and of a stripe of rows, which it reads batch by batch.
QUERIES, ROWS = 1024, 8192

Cell = Callable[[pa.Table, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def _dealt(blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")


def flat(batch: pa.RecordBatch, column: str) -> pa.RecordBatch:
    struct = batch.column(column)
    return pa.RecordBatch.from_arrays(struct.flatten(), names=[f.name for f in struct.type])


def runs_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Stretches of rows of one cell and side."""
    for batch in batches:
        cell, side = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
        for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
            if b > a:
                yield int(cell[a]), int(side[a]), batch.slice(a, b - a)


def on_grid(queries: DataFrame, rows: DataFrame, cell: Cell, schema: str, query_block: int = QUERIES, row_block: int = ROWS) -> DataFrame:
    """What ``cell(block of queries, batches of rows)`` yields for every block of ``queries`` and every stripe of ``rows``.

    Both sides are dealt to a grid: queries to blocks of about ``query_block``, rows to stripes of about
    ``row_block``, each block is copied to every stripe and each stripe to every block, and one stretch of a
    sorted partition is one cell. So copies grow as either table times the blocks of the other, no key can make
    a cell large, and a task holds one block of queries and one batch of rows. Rows are dealt by their place: both
    sides should be files or checkpoints, which have the same rows in the same places if a task is run again.
    An empty side gives no cell. Queries of a cell come as one table, in no order.
    """
    across, down = _blocks(queries, query_block), _blocks(rows, row_block)
    asked = queries.select(_dealt(across).alias("_b"), F.struct(*[F.col(c) for c in queries.columns]).alias("q"))
    held = rows.select(_dealt(down).alias("_b"), F.struct(*[F.col(c) for c in rows.columns]).alias("r"))
    number = F.col("_b").cast("long")
    asked = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("_s"), number.alias("_b"), "q")
    held = held.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("_q"), number.alias("_b"), "r")
    both = asked.select((F.col("_b") * down + F.col("_s")).alias("cell"), F.lit(0).alias("side"), "q", F.lit(None).cast(held.schema["r"].dataType).alias("r"))
    both = both.unionByName(held.select((F.col("_q") * down + F.col("_b")).alias("cell"), F.lit(1).alias("side"), F.lit(None).cast(asked.schema["q"].dataType).alias("q"), "r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, stretch in groupby(runs_of_cells(batches), key=lambda x: x[0]):
            block, own, first = [], iter(stretch), None
            for _, side, batch in own:
                if side:
                    first = batch
                    break
                block.append(flat(batch, "q"))
            if block and first is not None:
                yield from cell(pa.Table.from_batches(block), (flat(b, "r") for b in chain([first], (b for _, _, b in own))))
            for _ in own:
                pass

    return both.repartition("cell").sortWithinPartitions("cell", "side").mapInArrow(run, schema)
