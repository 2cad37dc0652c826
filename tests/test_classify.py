"""Classification runs with batches that fail, replies that leave articles out, selections, counts and samples."""

import datetime as dt
import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from newsloom.operators import classify as K

DAY = dt.datetime(2024, 1, 20)
SCHEMA = "id long, source_id int, title string, author string, url string, content_md string, summary string, category string, tags array<string>, entities array<string>, importance int, status string, classified boolean, published timestamp, fetched_at timestamp, story_size long"


def rule(number, query, **more):
    return Row(**({"id": number, "name": f"r{number}", "query": query, "archive": False, "keep": False, "boost": 0, "category": "", "importance": 0, "tags": []} | more))


RULES = [rule(1, "noise", archive=True, tags=["x"], category="tools", importance=2), rule(2, "precious", keep=True), rule(3, "hot", boost=3)]


def queue(spark, titles, sizes=None):
    sizes = sizes or {}
    rows = [(i, 1, t, "", f"https://x.example/{i}", "body", "", "old", ["t"], ["e"], 1, "unread", False, DAY - dt.timedelta(hours=i), DAY, sizes.get(i, 1)) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, SCHEMA)


def test_batches_fail_alone_and_what_is_left_out_stays(spark):
    own = queue(spark, [f"plain {i}" for i in range(13)]).where("id > 0").coalesce(1)

    def complete(some):
        ids = some["id"].tolist()
        if 5 in ids:
            raise RuntimeError("down")
        entries = [{"id": i, "category": "Models", "importance": 9 if i == 3 else 3, "tags": ["A", "a"]} for i in ids if i != 2] + [{"id": 99, "category": "models"}, {"id": 0}]
        first = [{"id": ids[0], "category": "tools", "importance": 0}]
        return "Here:\n```json\n" + json.dumps(first + entries) + "\n```"

    out, failures = K.classify(own, RULES, complete=complete, size=4)
    got = {r["id"]: r for r in out.collect()}
    assert {i for i, r in got.items() if r["by"] == "pending"} == {2, 5, 6, 7, 8} and not got[2]["classified"] and got[5]["category"] == "old"
    assert (got[1]["category"], got[1]["importance"], got[1]["tags"]) == ("models", 3, ["a"]) and got[3]["importance"] == 1
    assert [tuple(r) for r in failures.collect()] == [(5, [5, 6, 7, 8], "down")]
    nothing, failures = K.classify(own, RULES, complete=lambda some: "sorry", size=5)
    assert failures.count() == 3 and nothing.where("classified").isEmpty()


def test_rules_coverage_floors_and_lessons(spark, tmp_path):
    own = queue(spark, ["noise", "precious noise", "hot noise", "plain", "noise", "plain two"], {4: 3, 5: 5})
    learned = spark.createDataFrame([("source", "1", -1), ("tag", "t", -1)], "kind string, key string, delta int")
    out, failures = K.classify(own, RULES, learned)
    out, counts = K.counted(out)
    out.write.parquet(str(tmp_path / "out"))
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert failures is None and {i: r["by"] for i, r in got.items()} == {0: "rules", 1: "rules", 2: "fallback", 3: "fallback", 4: "fallback", 5: "fallback"}
    assert (got[0]["status"], got[0]["tags"], got[0]["entities"], got[0]["category"], got[0]["importance"]) == ("archived", ["x"], [], "tools", 2)
    assert {i: got[i]["importance"] for i in (2, 3, 4, 5)} == {2: 3, 3: 0, 4: 2, 5: 2} and got[4]["status"] == "unread"
    assert [r["article_id"] for r in K.archive_events(spark.read.parquet(str(tmp_path / "out")), F.current_timestamp()).orderBy("article_id").collect()] == [0, 1]
    want = {"articles": 6, "classified": 6, "by_rules": 2, "by_model": 0, "skipped_no_model": 4, "pending": 0, "archived": 2, "boosted": 3, "adjusted": 4, "by_coverage": 2}
    assert {k: v for k, v in counts.get.items() if k != "adjusted"} == {k: v for k, v in want.items() if k != "adjusted"}
    pending, _ = K.classify(own, RULES, learned, rules_only=True, ids=spark.createDataFrame([(0,), (3,), (5,), (77,)], "id long"))
    assert {r["id"]: (r["by"], r["importance"]) for r in pending.collect()} == {0: ("rules", 2), 3: ("pending", 1), 5: ("pending", 1)}


def test_plan_counts_each_article_once_and_shows_the_newest(spark):
    own = queue(spark, ["noise"] * 7 + ["precious", "hot noise", "noise", "plain", "other"], {9: 4})
    learned = spark.createDataFrame([("source", "1", 1)], "kind string, key string, delta int")
    plan, claims = K.classify_plan(own, RULES, learned, size=3)
    row = plan.first().asDict()
    assert row == {"pending": 12, "by_rules": 7, "archived": 7, "kept": 1, "boosted": 1, "covered": 1, "learned": 12, "learned_up": 12, "to_model": 5, "batches": 2, "unmatched": ["plain", "other"]}
    assert [(r["name"], r["effect"], r["matches"], len(r["sample"])) for r in claims.orderBy("place").collect()] == [("r1", "archive", 7, 5), ("r2", "keep", 1, 1), ("r3", "boost ★3", 1, 1)]
    empty, none = K.classify_plan(own.limit(0), RULES)
    assert empty.first()["pending"] == 0 and empty.first()["unmatched"] == [] and none.where("matches > 0").isEmpty()


def test_summaries_fail_alone(spark):
    own = queue(spark, ["a", "b"]).withColumn("content_md", F.when(F.col("id") == 1, F.lit("x" * 50)))

    def complete(title, body):
        return f"{title}: {len(body)}" if body else {}["none"]

    assert sorted((r["id"], r["summary"], r["error"]) for r in K.summarize(own, complete, 10).collect()) == [(0, None, "'none'"), (1, "b: 12", None)]
