import base64
import json

from pyspark.sql import functions as F

from newsloom.sources import readers as S

RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>
<item><guid isPermaLink="false">g1</guid><title> One </title><link>https://x.example/1?utm_source=rss</link><pubDate>Mon, 02 Jan 2023 15:04:05 GMT</pubDate><author>a@x.example</author><description>&lt;p&gt;Hi &lt;b&gt;there&lt;/b&gt;&lt;/p&gt;</description></item>
<item><title>Two</title><link>https://x.example/2</link><description>plain</description></item>
<item><title>No link</title></item></channel></rss>"""


def test_rss(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(RSS)
    rows = {r["title"]: r for r in S.read_feed_items(spark, str(tmp_path / "feed.xml")).collect()}
    assert rows["One"]["guid"] == "g1" and rows["One"]["content_md"] == "Hi **there**" and rows["One"]["published"].year == 2023
    assert rows["Two"]["guid"] == "https://x.example/2" and rows["Two"]["published"] is None
    items, errors = S.read_items(spark, [(1, "rss", str(tmp_path / "feed.xml")), (2, "fax", "x")])
    assert items.where("source_id = 1").count() == len(rows) and errors.first()["type"] == "fax"


def test_search_hits(spark, tmp_path):
    hits = [{"objectID": "1", "title": "A", "url": "https://a.example", "author": "u", "created_at": "2024-01-02T03:04:05Z"}, {"objectID": "2", "title": "Ask", "story_text": "<p>Why?</p>"}, {"objectID": "3", "title": " "}]
    (tmp_path / "h.json").write_text(json.dumps({"hits": hits}))
    rows = {r["guid"]: r for r in S.read_hn_items(spark, str(tmp_path / "h.json"), "https://hn.example/").collect()}
    assert set(rows) == {"hn-1", "hn-2"} and rows["hn-2"]["url"] == "https://hn.example/2" and rows["hn-2"]["content_md"] == "Why?" and rows["hn-1"]["published"] is not None


def test_mail(spark, tmp_path):
    code = lambda t: base64.urlsafe_b64encode(t.encode()).decode().rstrip("=")
    part = lambda kind, text: {"mimeType": kind, "body": {"data": code(text)}}
    mail = {"id": "m1", "threadId": "t1", "payload": {"mimeType": "multipart/mixed", "headers": [{"name": "Subject", "value": "Hi"}, {"name": "FROM", "value": "a"}, {"name": "Date", "value": "Tue, 02 Jan 2024 10:00:00 +0000"}], "parts": [{"mimeType": "multipart/alternative", "parts": [part("text/plain", "plain ü?"), part("text/html", "<p>x</p>")]}, part("text/plain", "later")]}}
    (tmp_path / "m.json").write_text(json.dumps(mail))
    row = S.read_mail_items(spark, str(tmp_path / "m.json"), F.lit("2024-01-05").cast("timestamp")).first()
    assert (row["title"], row["author"], row["content_md"], row["content_html"]) == ("Hi", "a", "plain ü?", "<p>x</p>")
    assert S.read_mail_items(spark, str(tmp_path / "m.json"), F.lit("2024-03-05").cast("timestamp")).count() == 0


def test_notes(spark, tmp_path):
    folder = tmp_path / "02-Atoms"
    folder.mkdir()
    (folder / "a.md").write_text('---\ntags:\n  - x\n---\n# Title\n[[b]] and [[c|d]]')
    (tmp_path / "g.md").write_text("---\nstatus: generated\n---\n")
    known = spark.createDataFrame([], "path string, content_hash string, origin string")
    rows = {r["path"].split("/")[-1]: r for r in S.read_notes(spark, str(tmp_path), known).collect()}
    a = rows["a.md"]
    assert (a["outcome"], a["note_type"], a["title"], a["tags"], a["wikilinks"]) == ("new", "atom", "Title", ["x"], ["b", "c"])
    assert rows["g.md"]["outcome"] == "skipped"


def test_rules_round_trip(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"name": "a", "query": "x", "actions": [{"type": "archive", "value": ""}]}]))
    rules = S.read_rules(spark, str(tmp_path / "r.json"))
    assert rules.first()["enabled"] is True
    S.write_rules(rules, str(tmp_path / "out"))
    again = S.read_rules(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in again.collect()] == [tuple(r) for r in rules.collect()]


def test_model_replies(spark):
    texts = ['```json\n[{"id": 1, "category": "models"}, {"id": 0}]\n```', '[{"id": 2, "category": "x"},\n]', "sorry"]
    df = spark.createDataFrame(list(enumerate(texts)), "reply int, text string")
    rows = [(r["reply"], r["item"] and r["item"]["id"], r["error"]) for r in S.parse_model_json(df).orderBy("reply").collect()]
    assert rows == [(0, 1, False), (1, 2, False), (2, None, True)]
