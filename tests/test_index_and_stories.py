"""The stored text index and the stories of a stream, against rebuilding and against one article after the other."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from newsloom.functions.simhash import article_simhash
from newsloom.functions.text import TITLE_STOPWORDS
from newsloom.operators import text_index as X
from newsloom.operators.search import fused_top
from newsloom.operators.tables import in_blocks
from newsloom.streaming.stories import read_stories, story_batch

DAY = dt.datetime(2024, 1, 20)


def _phrases(docs, columns, t):
    out = {}
    for kind, key, *texts in docs:
        n = 0
        for text in texts:
            words = re.findall(r"[^\W_]+", (text or "").lower())
            n += sum(words[i : i + len(t)] == list(t) for i in range(len(words)))
        if n:
            out[kind, key] = n
    return out


def test_text_index_of_batches_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(11)

    def some(ids, kinds=("article", "note")):
        return [(k, i, " ".join(rng.choices("a b c the The, x1 né".split(), k=rng.randint(0, 6))), rng.choice([None, "", "a b a b a", "the b c"])) for i in ids for k in kinds]

    schema = "kind string, id long, title string, content string"
    batches = [some(range(40)), some(range(30, 60)), some(range(5, 9))]
    removed = [("note", 7), ("article", 12), ("note", 999)]
    path = str(tmp_path)
    for number, docs in enumerate(batches):
        gone = spark.createDataFrame(removed, "kind string, id long") if number == 2 else None
        kept = [d for d in docs if number < 2 or d[:2] not in removed]
        for _ in range(2):  # a batch that runs again replaces what it wrote
            X.add_to_index(f"{path}/many", spark.createDataFrame(kept, schema).repartition(3), ["title", "content"], number, gone, buckets=8)
    final = {d[:2]: d for docs in batches for d in docs}
    final = [d for d in final.values() if d[:2] not in removed]
    many = X.read_index(spark, f"{path}/many", 8)
    X.compact_index(many, f"{path}/one")
    X.add_to_index(f"{path}/new", spark.createDataFrame(final, schema), ["title", "content"], buckets=8)
    phrases = [("a",), ("a", "b"), ("a", "b", "a"), ("the",), ("né", "x1"), ("b", "zzz"), ("zzz",), ("a", "a")]
    asked = spark.createDataFrame([(list(t),) for t in phrases], "t array<string>")
    want = {(t, k, i): n for t in phrases for (k, i), n in _phrases(final, 2, t).items()}
    for index in (many, X.read_index(spark, f"{path}/one", 8), X.read_index(spark, f"{path}/new", 8)):
        assert {(tuple(r["t"]), r["kind"], r["id"]): r["tf"] for r in X.phrase_frequencies(index, asked).collect()} == want
        assert {r["kind"]: r["docs"] for r in index.stats().collect()} == {k: sum(1 for d in final if d[0] == k and re.search(r"\w", f"{d[2]} {d[3] or ''}")) for k in ("article", "note")}
    plan = X.phrase_frequencies(many, asked.where("size(t) = 1"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "bucket#" in plan
    X.add_to_index(f"{path}/none", spark.createDataFrame([], schema), ["title", "content"], buckets=8)
    assert X.phrase_frequencies(X.read_index(spark, f"{path}/none", 8), asked).count() == 0


def test_postings_are_shuffled_in_groups_and_come_out_single(spark):
    docs = [(k, i, "a b a", "b" if i % 2 else None) for k in ("article", "note") for i in range(600)]
    grouped = X.grouped_postings(spark.createDataFrame(docs, "kind string, id long, title string, content string").coalesce(1), ["title", "content"])
    assert {(r["term"], r["kind"], r["column"], len(r["ids"])) for r in grouped.where("first < 256 and size(ids) < 256").collect()} <= {(t, k, c, n) for t in "ab" for k in ("article", "note") for c in (0, 1) for n in (44, 88)}
    assert grouped.count() < 20 and grouped.where("size(ids) > 256").count() == 0
    want = {(k, i, 0, t, p) for k, i, _, _ in docs for t, p in (("a", (0, 2)), ("b", (1,)))} | {(k, i, 1, "b", (0,)) for k, i, _, c in docs if c}
    got = [(*r[:4], tuple(r["places"])) for r in X.single(grouped).collect()]
    assert set(got) == want and len(got) == len(want)


def test_pairs_of_a_frequent_key_meet_once_in_small_cells(spark):
    rows = spark.createDataFrame([("often", i) for i in range(100)] + [("seldom", i) for i in range(3)], "w string, a long")
    x, y, on = in_blocks(rows, rows.where("a < 60").withColumnRenamed("a", "b"), "w", "a", "b", most=10)
    met = x.join(y, on).select("a", "b", *on).collect()
    assert sorted((r["w"], r["a"], r["b"]) for r in met) == sorted([("often", a, b) for a in range(100) for b in range(60)] + [("seldom", a, b) for a in range(3) for b in range(3)])
    cells = {}
    for r in met:
        cells.setdefault(tuple(r[c] for c in on), []).append(r)
    assert len(cells) == 61 and max(map(len, cells.values())) < 600


def _serial_stories(rows, batches, days):
    """One article after the other, against those of its batch and those of earlier batches within the window."""
    stop = set(TITLE_STOPWORDS)
    parsed, known, story = {}, [], {}
    for i, title, body, at in rows:
        words = {re.sub(r"[.\-]+$", "", w) for w in re.findall(r"[a-z0-9][a-z0-9.\-]*", title.lower()) if len(w) >= 2 and w not in stop}
        parsed[i] = (frozenset(words), at)
    hashes = {r["id"]: r["h"] for r in batches["hashes"]}
    for ids in batches["ids"]:
        since = max(parsed[i][1] for i in ids) - dt.timedelta(days=days)
        pool = [k for k in known if parsed[k][1] >= since]
        for i in sorted(ids):
            t = parsed[i][0]
            scored = []
            for k in pool:
                u = parsed[k][0]
                va, vb = ({w for w in x if re.search("[0-9]", w)} for x in (t, u))
                if len(t & u) >= 4 and len(t & u) / len(t | u) >= 0.55 and (not va or not vb or va & vb):
                    scored.append((-len(t & u) / len(t | u), k))
            near = [k for k in pool if hashes[i] and hashes[k] and ((hashes[i] ^ hashes[k]) & (1 << 64) - 1).bit_count() <= 3]
            parent = min(scored)[1] if scored else min(near, default=None)
            root = None if parent is None else story.get(parent) or parent
            story[i] = root or 0
            if root:
                story[root] = root
            pool.append(i)
        known = known + list(ids)
    return story


def test_stories_of_a_stream_equal_the_serial_order(spark, tmp_path):
    rng = random.Random(8)
    words = "alpha beta gamma delta nova4 nova5 launch model opens market chips robots".split()
    base = [rng.sample(words, 6) for _ in range(12)]
    rows = []
    for i in range(1, 121):
        own = list(rng.choice(base))
        own[rng.randrange(6)] = rng.choice(words)
        rows.append((i, " ".join(own) if i % 9 else f"short {i}", "same body " * 30 if i % 9 == 0 and i % 2 else f"body {i} " * 40, DAY + dt.timedelta(hours=18 * i)))
    ids = [range(1, 31), range(31, 32), range(32, 80), range(80, 121)]
    schema = "id long, title string, content_md string, fetched_at timestamp_ntz"
    hashes = spark.createDataFrame(rows, schema).select("id", article_simhash(F.col("title"), F.col("content_md")).alias("h")).collect()
    for number, some in enumerate(ids):
        own = spark.createDataFrame([r for r in rows if r[0] in some] + ([rows[30]] if number == 2 else []), schema).repartition(3)
        for _ in range(1 + (number == 2)):  # a batch that runs again changes nothing
            story_batch(str(tmp_path), 30)(own, number)
    got = {r["id"]: r["story_id"] for r in read_stories(spark, str(tmp_path)).collect()}
    want = _serial_stories(rows, {"ids": ids, "hashes": hashes}, 30)
    assert got == want and len(set(want.values())) > 5
    story_batch(str(tmp_path), 30)(spark.createDataFrame([], schema), 4)
    story_batch(str(tmp_path), 30)(spark.createDataFrame([(500, rows[2][1], "late", rows[2][3] + dt.timedelta(days=400))], schema), 5)
    assert {r["id"]: r["story_id"] for r in read_stories(spark, str(tmp_path)).collect()}[500] == 0


def test_headlines_of_a_stream_are_compared_as_numbers_that_words_keep(spark, tmp_path):
    schema = "id long, title string, content_md string, fetched_at timestamp_ntz"
    titles = ["robots open chips markets", "robots open chips alpha", "nova5 robots open beta", "nova5 robots open beta gamma"]
    before = {}
    for number, title in enumerate(titles):
        for _ in range(1 + (number == 2)):  # a batch that runs again numbers its words as before
            story_batch(str(tmp_path), 30)(spark.createDataFrame([(number + 1, title, f"{'abcd'[number] * 5} " * 40, DAY)], schema), number)
            words = {r["w"]: r["i"] for r in spark.read.parquet(f"{tmp_path}/words").collect()}
        assert before.items() <= words.items() and len(set(words.values())) == len(words) and set(words) >= set(title.split())
        assert all(words[w] < min(before.values(), default=1) for w in words.keys() - before.keys())
        before = words
    kept = spark.read.parquet(f"{tmp_path}/prefixes")
    assert dict(kept.dtypes)["r"] == dict(kept.dtypes)["v"] == "array<int>"
    assert {tuple(r["v"]) for r in kept.where("batch = 3").collect()} == {(words["nova5"],)}
    assert {r["id"]: r["story_id"] for r in read_stories(spark, str(tmp_path)).collect()} == {1: 0, 2: 0, 3: 3, 4: 3}


def test_an_index_keeps_groups_of_each_task_without_a_shuffle_and_compacts_them_as_groups(spark, tmp_path):
    docs = spark.createDataFrame([("article" if i % 2 else "note", i, "often", f"own{i} often") for i in range(1200)], "kind string, id long, title string, content string")
    path = str(tmp_path)
    X.add_to_index(f"{path}/many", docs.repartition(3), ["title", "content"])
    often = spark.read.parquet(f"{path}/many/postings").where("term = 'often'")
    # a row has 256 documents of a kind, column and slice of a task at most, and each task writes its own file
    assert often.count() <= 3 * 2 * 2 * X.SLICES and often.select(F.input_file_name()).distinct().count() == 3
    X.add_to_index(f"{path}/many", docs.where("id % 3 = 0").withColumn("content", F.lit("later")), ["title", "content"], 1, docs.where("id % 5 = 4"))
    many = X.read_index(spark, f"{path}/many")
    X.compact_index(many, f"{path}/one")
    one = spark.read.parquet(f"{path}/one/postings")
    assert one.where("term = 'often'").count() <= (3 + 4) * 2 * 2 * X.SLICES
    left = [(r["term"], r["column"], r["id"]) for r in X.single(one).collect()]
    want = [("often", 0, i) for i in range(1200) if i % 3 == 0 or i % 5 != 4] + [("later", 1, i) for i in range(0, 1200, 3)]
    want += [(t, 1, i) for i in range(1200) if i % 3 and i % 5 != 4 for t in ("often", f"own{i}")]
    # what is removed in a batch that also has it is there
    assert sorted(left) == sorted(want)


def test_phrases_in_blocks_are_found_as_at_once_and_postings_shuffled_once(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    docs = [("note", i, " ".join(rng.choices("a b c d", k=30)), None) for i in range(60)]
    X.add_to_index(str(tmp_path), spark.createDataFrame(docs, "kind string, id long, title string, content string").repartition(2), ["title", "content"], buckets=4)
    phrases = [tuple(rng.choices("abcde", k=n)) for n in (1, 2, 2, 3, 3, 4, 5) for _ in range(9)] + [("a", "a", "a")]
    asked = spark.createDataFrame([(list(t),) for t in {*phrases}], "t array<string>")
    index, want = X.read_index(spark, str(tmp_path), 4), {(t, i): n for t in {*phrases} for (_, i), n in _phrases(docs, 2, t).items()}
    found = X.phrase_frequencies(index, asked)
    assert {(tuple(r["t"]), r["id"]): r["tf"] for r in found.collect()} == want and len(want) > 500
    # no phrase is joined to postings of one of its words, which would make a row for each phrase of a word
    assert "explode(" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(X, "PHRASES", 10)
    assert {(tuple(r["t"]), r["id"]): r["tf"] for r in X.phrase_frequencies(index, asked).collect()} == want


def test_fused_top_asks_for_keywords_and_vectors_once(spark):
    rows, asked = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def counted(n):
        def run(frames):
            for f in frames:
                n.add(len(f))
                yield f

        return run

    keywords = spark.createDataFrame([(0, "note", 3, 1), (0, "article", 1, 2), (1, "article", 2, 1)], "qid long, kind string, id long, pos int").mapInPandas(counted(rows), "qid long, kind string, id long, pos int")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "qid long, vector array<double>").mapInPandas(counted(asked), "qid long, vector array<double>")
    vectors = spark.createDataFrame([("article", 1, [1.0, 0.0]), ("article", 2, [0.9, 0.1]), ("note", 3, [0.0, 1.0])], "kind string, id long, embedding array<double>")
    got = {(r["qid"], r["kind"], r["id"]): round(r["score"], 9) for r in fused_top(keywords, vectors, queries, 2).collect()}
    both = lambda *places: round(sum(1 / (60 + p) for p in places), 9)
    assert got == {(0, "article", 1): both(2, 1), (0, "note", 3): both(1, 3), (1, "article", 2): both(1)}
    assert rows.value == 3 and asked.value == 2
