import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as X
from newsloom.functions.markdown import clean_markdown, extract_pages, html_to_markdown
from newsloom.functions.simhash import hamming, simhash64
from newsloom.functions.url import normalize_url


def values(spark, rows, function):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    return [r["y"] for r in df.select("i", function(F.col("x")).alias("y")).orderBy("i").collect()]


def test_normalize_url(spark):
    cases = {
        "https://Example.com/Post?utm_source=rss&id=7#top": "https://example.com/Post?id=7",
        "https://example.com/a/": "https://example.com/a",
        "HTTP://EXAMPLE.com/?b=2&a=1&b=1": "http://example.com/?a=1&b=2&b=1",
        "https://example.com/x?flag&fbclid=9": "https://example.com/x?flag=",
        "  ": "",
        "https://example.com/": "https://example.com",
    }
    assert values(spark, list(cases), normalize_url) == list(cases.values())
    assert values(spark, [None], normalize_url) == [None]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Lab releases Orion 5 with longer context window", "Lab releases Orion 5 with a longer context window today", True),
        ("Lab releases Orion 5.1 with longer context window", "Lab releases Orion 4.2 with longer context window", False),
        ("New chip plant opens", "New chip plant opens", False),
        ("Regulators open probe into chip maker exports", "Chip maker exports face probe as regulators open inquiry", True),
        ("", "Regulators open probe into chip maker exports", False),
    ],
)
def test_same_story(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    tokens = [X.title_tokens(F.col(c)) for c in "ab"]
    assert df.select(X.same_story(*tokens).alias("s")).first()["s"] is same


def test_title_tokens_trim_after_stop_words(spark):
    assert values(spark, ["The GPT-5. today. is here"], X.title_tokens) == [["gpt-5", "today"]]


def test_slugs_and_names(spark):
    assert values(spark, ["Hello, World!", "  --  ", "x" * 90, "Ünïcode"], X.slugify) == ["hello-world", "note", "x" * 80, "n-code"]
    assert values(spark, ["open-ai", "gpt-5", "rag", "hugging face", "iPhone", "vector-db"], X.display_name) == ["OpenAI", "GPT-5", "RAG", "Hugging Face", "iPhone", "Vector Db"]
    assert values(spark, ["open-ai-concept-2", "rag"], X.canon_key) == ["openai", "rag"]


def test_concepts_of_an_article(spark):
    df = spark.createDataFrame([([("Open AI", "org"), ("Paris", "place")], ["Agents ", "ai", "Agents"])], "e array<struct<name:string,type:string>>, t array<string>")
    assert df.select(X.concept_slugs(F.col("e"), F.col("t")).alias("s")).first()["s"] == ["agents", "open-ai"]


def test_simhash_of_near_and_far_texts(spark):
    a, b, c = "the quick brown fox jumps over the lazy dog " * 8, "the quick brown fox jumps over the lazy dog " * 8 + "cat", "completely different words about another subject entirely " * 8
    df = spark.createDataFrame([(a, b, c)], "a string, b string, c string").select(*[simhash64(F.col(x)).alias(x) for x in "abc"])
    near, far, none = df.select(hamming(F.col("a"), F.col("b")), hamming(F.col("a"), F.col("c")), simhash64(F.lit("a b"))).first()
    assert near <= 6 and far >= 15 and none == 0


def test_markdown(spark):
    md = "a\n```html\n<div>x</div>\n```\n```go\nf()\n```\n\n\n\n\nb\n```\nopen"
    assert values(spark, [md], clean_markdown) == ["a\n<div>x</div>\n```go\nf()\n```\n\n\nb\n```\nopen\n```"]
    page = "<html><head><title>T</title></head><body><nav>menu</nav><article><h1>Head</h1><p>One <b>two</b> <a href='/x'>link</a></p><ul><li>i</li></ul></article></body></html>"
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    assert "**two** [link](/x)" in html_to_markdown(df).first()["markdown"]
    assert extract_pages(df).first()["outcome"] == "failed"
    long = page.replace("One", "word " * 60)
    row = extract_pages(spark.createDataFrame([(1, long)], "page_id int, html string")).first()
    assert row["outcome"] == "extracted" and row["title"] == "T" and "menu" not in row["markdown"]


def test_links(spark):
    md = "[a](https://x.example/1) and https://x.example/1, https://y.example/p.png https://z.example/2."
    assert [(r["text"], r["url"]) for r in values(spark, [md], X.extract_links)[0]] == [("a", "https://x.example/1"), ("https://z.example/2.", "https://z.example/2")]
    assert values(spark, ["[[a|b]] [[ c#d ]] [[a]] [[]]"], X.parse_wikilinks) == [["a", "c"]]


def test_frontmatter(spark):
    note = '---\ntitle: "T"\ntags:\n  - one\n  - "two"\n---\nbody'
    df = spark.createDataFrame([(note,)], "x string").select(X.split_frontmatter(F.col("x")).alias("f"))
    tags = df.select(X.parse_tags(F.col("f.frontmatter")).alias("t"), X.parse_title(F.col("f.frontmatter"), F.col("f.body"), F.lit("a/n.md")).alias("title"), "f.body").first()
    assert tags["t"] == ["one", "two"] and tags["title"] == "T" and tags["body"] == "body"
