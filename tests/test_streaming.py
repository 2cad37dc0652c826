"""Streams over several batches against what one pass gives."""

import datetime as dt
import random

from newsloom.operators.ingest import health_streaks
from newsloom.streaming.health import run_health
from newsloom.streaming.streams import landing, stream_dedup

DAY = dt.datetime(2024, 1, 20)
SCHEMA = "id long, source_id int, cycle_ts timestamp_ntz, outcome string"


def test_health_goes_on_from_batch_to_batch_and_over_a_restart(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.randrange(3), DAY + dt.timedelta(hours=i // 2), rng.choice(("ok", "failed", "failed", "empty"))) for i in range(160)]
    want = {r["id"]: r["streak"] for r in health_streaks(spark.createDataFrame(rows, SCHEMA)).collect()}
    landed, work = f"{tmp_path}/landed", f"{tmp_path}/work"
    for number, some in enumerate((rows[:50], rows[50:51], rows[51:120], rows[120:])):
        spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(landed)
        if number in (1, 3):
            out = run_health(landing(spark, landed, 1), work)
    got = {r["id"]: r for r in out.collect()}
    assert {i: r["streak"] for i, r in got.items()} == want and not any(r["late"] for r in got.values())
    assert {i for i, r in got.items() if r["warning"]} == {i for i, s in want.items() if s == 3 and rows[i][3] != "ok"}
    # a late cycle changes nothing, and the next goes on from the last
    source, last = rows[-1][1], rows[-1][3]
    spark.createDataFrame([(900, source, DAY, "ok"), (901, source, DAY + dt.timedelta(days=9), last), (902, 77, DAY, "empty")], SCHEMA).coalesce(1).write.mode("append").parquet(landed)
    again = {r["id"]: r for r in run_health(landing(spark, landed, 1), work).collect()}
    assert again[900]["late"] and again[900]["streak"] is None and not again[900]["warning"]
    assert again[901]["streak"] == want[159] + 1 and again[902]["streak"] == 1 and len(again) == len(rows) + 3


def test_first_of_each_url_within_the_window_and_late_items_dropped(spark, tmp_path):
    schema, landed, work = "url string, fetched_at timestamp", f"{tmp_path}/landed", f"{tmp_path}/work"
    out = []
    for some in ([("a", 0), ("b", 0), ("b", 0)], [("a", 10)], [("c", 60)], [("d", 5), ("a", 62), ("c", 61)], [("e", 62)]):
        spark.createDataFrame([(u, DAY + dt.timedelta(days=d)) for u, d in some], schema).coalesce(1).write.mode("append").parquet(landed)
        stream = stream_dedup(landing(spark, landed, 1), "30 days")
        stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{work}/state").format("parquet").start(f"{work}/out").awaitTermination()
        out.append(sorted(r["url"] for r in spark.read.schema(schema).parquet(f"{work}/out").collect()))
    assert out == [["a", "b"], ["a", "b"], ["a", "b", "c"], ["a", "a", "b", "c"], ["a", "a", "b", "c", "e"]]
