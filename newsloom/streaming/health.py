"""The health of sources as keyed state of a stream."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OUT = "id long, source_id int, cycle_ts timestamp_ntz, outcome string, streak int, warning boolean, late boolean"
#: Of a source: its last cycle, how that ended and for how many cycles it has.
_STATE = "cycle_ts timestamp_ntz, id long, outcome string, streak int"


class HealthProcessor(StatefulProcessor):
    """Counts how many cycles of a source in a row have ended alike, and warns when failures or empty results reach ``warn_after``.

    Cycles are taken in the order of time, then id. One that isn't after the last of an earlier batch is late: it comes out
    without a streak and changes nothing, as what was said after it stands.
    """

    def __init__(self, warn_after: int):
        self.warn_after = warn_after

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        cycles = pd.concat(list(rows)).sort_values(["cycle_ts", "id"], kind="stable", ignore_index=True)
        before = self.last.get() if self.last.exists() else None
        late = pd.Series(False, index=cycles.index)
        if before is not None:
            at = pd.Timestamp(before[0])
            late = (cycles["cycle_ts"] < at) | (cycles["cycle_ts"] == at) & (cycles["id"] <= before[1])
        own = cycles[~late]
        streak = np.zeros(0, np.int64)
        if len(own):
            outcome = own["outcome"]
            new = (outcome != outcome.shift(fill_value=before[2] if before is not None else None)).to_numpy()
            place = np.arange(len(own))
            start = np.maximum.accumulate(np.where(new, place, -1))
            streak = np.where(start < 0, place + 1 + (before[3] if before is not None else 0), place - start + 1)
            end = own.iloc[-1]
            self.last.update((end["cycle_ts"].to_pydatetime(), int(end["id"]), end["outcome"], int(streak[-1])))
        out = cycles[["id", "source_id", "cycle_ts", "outcome"]].copy()
        out["streak"] = pd.Series(streak, index=own.index, dtype="Int32").reindex(out.index)
        out["warning"] = (out["streak"] == self.warn_after).fillna(False).astype(bool) & (out["outcome"] != "ok")
        out["late"] = late
        yield out

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Keyed state needs this store; queries that start here have it, other streams of the session what they had."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def stream_health(log: DataFrame, warn_after: int = 3) -> DataFrame:
    """The fetch log of a stream with ``streak``, ``warning`` (at the cycle at which a streak that isn't fine reaches ``warn_after``) and ``late``.

    To be started within ``rocksdb_state``. A batch's cycles of one source are held by one task, so its size should be
    bounded, as by a number of files; state is one row a source.
    """
    rows = log.select("id", "source_id", "cycle_ts", "outcome")
    return rows.groupBy("source_id").transformWithStateInPandas(HealthProcessor(warn_after), _OUT, "Append", "None")


def run_health(log: DataFrame, folder: str, warn_after: int = 3) -> DataFrame:
    """Runs the stream over all that has landed and returns what it has written to ``folder`` so far; goes on where it stopped."""
    spark = log.sparkSession
    with rocksdb_state(spark):
        stream_health(log, warn_after).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").outputMode("append").format("parquet").start(f"{folder}/out").awaitTermination()
    return spark.read.schema(_OUT).parquet(f"{folder}/out")
