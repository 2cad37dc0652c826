import datetime as dt
import random

from pyspark.sql import functions as F

from newsloom.functions.simhash import article_simhash
from newsloom.operators import documents as D
from newsloom.operators import graph as G
from newsloom.operators import ingest as I
from newsloom.operators import learn as L
from newsloom.operators import records as C
from newsloom.operators import rules as R
from newsloom.operators import search as S
from newsloom.operators import tables as T
from newsloom.operators.search import keyword_rank, keyword_scores
from newsloom.operators.text_index import add_to_index, read_index
from newsloom.operators.themes import cluster_themes

DAY = dt.datetime(2024, 1, 20)


def articles(spark, titles):
    df = spark.createDataFrame([(i + 1, t, f"body {i} {'word ' * i}") for i, t in enumerate(titles)], "id long, title string, content_md string")
    return df.withColumn("simhash", article_simhash(F.col("title"), F.col("content_md")))


def test_five_outlets_tell_one_story(spark):
    own = articles(
        spark,
        [
            "Acme unveils Orion 5 reasoning model for enterprise coding teams",
            "Acme unveils Orion 5 reasoning model for enterprise teams",
            "Orion 5: Acme unveils reasoning model for enterprise coding",
            "Acme unveils the Orion 5 reasoning model, enterprise coding teams say",
            "Enterprise coding teams get Acme Orion 5 reasoning model",
            "Storm closes northern harbour for second day",
        ],
    )
    stories = {r["id"]: r["story_id"] for r in I.assign_stories(own).collect()}
    assert stories == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0}
    named = own.select("id", F.concat(F.lit("s"), "id").alias("source_name")).join(I.assign_stories(own), "id")
    row = I.story_coverage(named).first()
    assert (row["story_size"], row["outlets"], row["sources"]) == (5, 5, "s1,s2,s3,s4,s5")


def test_story_pairs_are_compared_where_they_meet(spark):
    """No pair is shuffled to be made unique; a similarity of just the least counts, also where its product isn't exact (40 * 0.55)."""
    both, own = [f"both{c}" for c in "abcdefghijklmnopqrstuv"], [f"own{c}" for c in "abcdefghijklmnopqr"]
    pairs = I.story_pairs(articles(spark, [" ".join(both), " ".join(both + own), "nothing like any other headline here"]))
    assert [(r["later"], r["earlier"], r["score"]) for r in pairs.collect()] == [(2, 1, 0.55)]
    assert "Aggregate" not in pairs._jdf.queryExecution().optimizedPlan().toString()


def test_stories_compare_headlines_once(spark):
    """Parents by title are used twice: what they come from, tokens and pairs, is not in the plan of either use."""
    parents = I.story_parents(articles(spark, ["alpha beta gamma delta epsilon", "alpha beta gamma delta zeta", "alpha beta gamma delta epsilon"]))
    plan = parents._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "regexp_extract_all" not in plan
    assert {(r["id"], r["parent"], r["by"]) for r in parents.collect()} == {(2, 1, "title"), (3, 1, "title")}


def test_story_pairs_equal_brute_force_with_repeats(spark):
    base = ["alpha beta gamma delta epsilon", "alpha beta gamma delta zeta", "alpha beta gamma delta epsilon", "eta theta iota kappa 5.1", "eta theta iota kappa 5.2", ""]
    pairs = {(r["later"], r["earlier"]) for r in I.story_pairs(articles(spark, base)).collect()}
    assert pairs == {(2, 1)}
    classes = {r["id"]: r["class"] for r in I.headline_classes(articles(spark, base)).collect()}
    assert classes == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}


def test_health(spark):
    kinds = ["failed", "failed", "failed", "ok", "empty", "empty", "empty"]
    log = spark.createDataFrame([(i, 1, DAY + dt.timedelta(hours=i), k, "boom") for i, k in enumerate(kinds)], "id long, source_id int, cycle_ts timestamp, outcome string, message string")
    row = I.source_health(log).first()
    assert (row["consecutive_failures"], row["empty_cycles"]) == (0, 3) and row["last_error"]
    assert [r["outcome"] for r in I.health_warnings(log).orderBy("cycle_ts").collect()] == ["failed", "empty"]


def rule(i, query, **more):
    return {"id": i, "name": f"r{i}", "query": query, "archive": False, "keep": False, "boost": 0, "category": "", "importance": 0} | more


def test_rules_in_order(spark):
    rules = [rule(1, r"\bkeep\b", keep=True), rule(2, "deal", archive=True), rule(3, "launch", boost=3), rule(4, "^tool", category="tools", importance=2)]
    own = spark.createDataFrame([(1, "keep this deal"), (2, "a DEAL"), (3, "launch deal"), (4, "tool news"), (5, "nothing")], "id long, title string").withColumns({"author": F.lit(""), "url": F.lit(""), "status": F.lit("unread")})
    got = {r["id"]: (r["rule"], r["floor"], r["to_model"]) for r in R.decide(own, rules).collect()}
    assert got == {1: (1, 0, True), 2: (2, 0, False), 3: (2, 3, True), 4: (4, 0, False), 5: (None, 0, True)}
    done = {r["id"]: (r["category"], r["importance"], r["status"]) for r in R.apply_rules(R.decide(own, rules)).collect()}
    assert done == {2: ("general", 1, "archived"), 4: ("tools", 2, "unread")}


def test_regex_dialect(spark):
    df = spark.createDataFrame([("éopenai",), ("OPENAI\n",), ("x openai",)], "t string")
    hit = [r[0] for r in df.select(F.col("t").rlike(R.portable_regex(r"\bopenai"))).collect()]
    assert hit == [True, True, True]
    assert [r[0] for r in df.select(F.col("t").rlike(R.portable_regex("openai$"))).collect()] == [True, False, True]


def test_invalid_rules_are_split_off(spark):
    rules = spark.createDataFrame([(1, "a", "(", True), (2, "b", "ok", True), (3, "c", "ok", False), (4, " ", "ok", True)], "id int, name string, query string, enabled boolean")
    good, bad = R.valid_rules(rules)
    assert [r["id"] for r in good] == [2] and [r["id"] for r in bad] == [1]


def test_learning_from_verdicts(spark):
    def rows(source, n, read, archived, starred):
        return [(source, [], read, archived, starred)] * n

    verdicts = spark.createDataFrame(rows(1, 12, False, True, False) + rows(2, 9, True, False, False) + rows(2, 3, True, False, True) + rows(3, 9, False, True, False) + rows(4, 12, True, False, False), "source_id int, tags array<string>, is_read boolean, archived boolean, starred boolean")
    sources = spark.createDataFrame([(i, f"s{i}") for i in range(1, 5)], "id int, name string")
    got = {r["label"]: r["delta"] for r in L.signals(verdicts, sources, min_samples=10).collect()}
    assert got == {"s1": -1, "s2": 1, "s3": 0, "s4": 0}


def test_upsert_keeps_reader_columns(spark):
    stored = spark.createDataFrame([(1, "a", "read"), (2, "b", "unread")], "id int, title string, status string")
    new = spark.createDataFrame([(2, "B", "archived"), (3, "c", "unread")], "id int, title string, status string")
    got = {tuple(r) for r in T.upsert(stored, new, ["id"], keep=("status",)).collect()}
    assert got == {(1, "a", "read", False), (2, "B", "unread", False), (3, "c", "unread", True)}


def test_note_slugs_avoid_owners(spark):
    own = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "id long, slug string")
    taken = spark.createDataFrame([("a-2",)], "slug string")
    assert {r["id"]: r["note_slug"] for r in G.allocate_note_slugs(own, taken).collect()} == {1: "a", 2: "a-3", 3: "b", 4: "a-4"}


def test_themes_are_picked_greedily(spark):
    notes = [(c, n) for n in (1, 2, 3) for c in ("agents", "memory")] + [("chips", 4)]
    m = spark.createDataFrame(notes, "concept_slug string, note_id long")
    none = spark.createDataFrame([], "slug string, pos int")
    rows = cluster_themes(m, none).collect()
    assert [(r["seed"], r["concepts"], r["notes"]) for r in rows] == [("agents", ["agents", "memory"], 3)]


def test_phrase_search(spark, tmp_path):
    docs = spark.createDataFrame([("note", 1, "red apple", "banana split"), ("article", 1, "apple red", "no fruit"), ("article", 2, "", "a red apple pie")], "kind string, id long, title string, content string")
    queries = spark.createDataFrame([(1, '"red apple"'), (2, "banana"), (3, " ")], "qid int, query string")
    add_to_index(str(tmp_path), docs, ["title", "content"])
    got = {(r["qid"], r["kind"], r["id"], r["pos"]) for r in keyword_rank(keyword_scores(read_index(spark, str(tmp_path)), queries)).collect()}
    assert got == {(1, "note", 1, 1), (1, "article", 2, 2), (2, "note", 1, 1)}


def test_streaks_go_on_from_before_and_over_days(spark):
    rows = [(i, 1, DAY + dt.timedelta(hours=7 * i), "failed" if i < 9 or i in (12, 13) else "ok") for i in range(16)] + [(99, 2, DAY, "ok")]
    log = spark.createDataFrame(rows, "id long, source_id int, cycle_ts timestamp_ntz, outcome string")

    def expected(last, streak):
        out = {}
        for i, _, _, outcome in rows[:16]:
            last, streak = outcome, streak + 1 if outcome == last else 1
            out[i] = streak
        return out | {99: 1}

    assert {r["id"]: r["streak"] for r in I.health_streaks(log).collect()} == expected("", 0)
    before = spark.createDataFrame([(1, "failed", 4), (7, "ok", 2)], "source_id int, outcome string, streak int")
    assert {r["id"]: r["streak"] for r in I.health_streaks(log, before).collect()} == expected("failed", 4)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [b ^ sum(1 << k for k in rng.sample(range(64), n)) for b in base for n in (1, 2, 3, 4)] + base[:5] + [0, 0]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r["later"], r["earlier"], r["distance"]) for r in I.near_duplicates(spark.createDataFrame(list(enumerate(signed)), "id long, simhash long")).collect()}
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(max(i, j), min(i, j), (v ^ w).bit_count()) for v, i in first.items() for w, j in first.items() if v and w and i != j and (v ^ w).bit_count() <= 3}
    assert got == want


def test_patterns_of_another_dialect(spark):
    rules = spark.createDataFrame([(i, f"r{i}", q, True) for i, q in enumerate([r"\p{L}+ai", r"\Qa.b\E", "(?P<x>ai)", "(?=ai)", "a++", r"(a)\1", "[[:alpha:]]+x", "(", r"\p{Greek}"])], "id int, name string, query string, enabled boolean")
    good, bad = R.valid_rules(rules)
    assert [r["id"] for r in good] == [0, 1, 2, 6, 8] and [r["id"] for r in bad] == [3, 4, 5, 7]
    own = spark.createDataFrame([(1, "Mumbai a.b", "", ""), (2, "axb", "", ""), (3, "λ", "", "")], "id int, title string, author string, url string")
    assert sorted((r["id"], r["rule"]) for r in R.rule_matches(own, good).collect()) == [(1, 0), (1, 1), (1, 2), (2, 6), (3, 8)]


def test_vector_places_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [("note" if i % 3 else "article", i, [float(rng.randint(-2, 2)) for _ in range(3)] if i % 11 else None) for i in range(60)]
    vectors = spark.createDataFrame(rows, "kind string, id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(1, [1.0, 2.0, 0.5]), (2, [0.0, 0.0, 0.0]), (3, None)], "qid long, vector array<float>")

    def cosine(a, b):
        na, nb = (sum(x * x for x in v) ** 0.5 for v in (a or [], b))
        return 0.0 if not a or not na or not nb else round(sum(x * y for x, y in zip(a, b)) / na / nb, 9) + 0.0

    for qid, vector in ((1, [1.0, 2.0, 0.5]), (2, [0.0, 0.0, 0.0])):
        order = sorted(rows, key=lambda r: (-cosine(r[2], vector), r[0] == "article", r[1]))
        top = [(r["kind"], r["id"]) for r in S.vector_rank(vectors, queries, 7).where(f"qid = {qid}").orderBy("pos").collect()]
        assert top == [r[:2] for r in order[:7]]
        wanted = spark.createDataFrame([(qid, *r[:2]) for r in rows[::4]] + [(qid, "note", 999)], "qid long, kind string, id long")
        got = {(r["kind"], r["id"]): r["pos"] for r in S.vector_positions(vectors, queries, wanted).collect()}
        assert got == {r[:2]: order.index(r) + 1 for r in rows[::4]}


def test_records_change_by_table(spark):
    table = spark.createDataFrame([(1, "a", True, DAY), (2, "b", True, DAY), (3, "c", False, DAY)], "id long, name string, enabled boolean, updated_at timestamp")
    changes = spark.createDataFrame([(1, "delete", None), (2, "update", "B"), (3, "enable", None), (9, "update", "x"), (5, "create", "n"), (6, "create", "m")], "id long, op string, name string")
    got = {(r["id"], r["name"], r["enabled"]) for r in C.change_records(table, changes, F.current_timestamp()).collect()}
    assert got == {(2, "B", True), (3, "c", True), (4, "n", None), (5, "m", None)}


def test_documents(spark):
    row = spark.sql("SELECT 's' AS slug, 'A · B' AS title, timestamp_ntz '2024-01-02 03:04:05' AS created, '' AS summary, array(struct('a' AS slug, 'A' AS name, 2L AS notes, 5L AS total), struct('b' AS slug, 'B' AS name, 2L AS notes, 2L AS total), struct('c' AS slug, 'C' AS name, 1L AS notes, 2L AS total)) AS concepts, array(struct('2024-01-02' AS day, 1L AS id, 'n1' AS slug, 'One' AS title), struct('' AS day, 2L AS id, 'n2' AS slug, 'Two' AS title)) AS notes")
    assert D.render_molecules(row).first()["document"] == (
        '---\ntype: molecule\ncreated: "2024-01-02 03:04"\nstatus: active\ntags:\n  - synthesis\n  - ai\n  - theme\n---\n\n# 🧪 A · B\n\n## Central idea\n2 note(s) on 2024-01-02 name A, B and C together.\n\n'
        "## How it developed\n- 2024-01-02 · [[n1]] — One\n- [[n2]] — Two\n\n## Concepts in play\n- [[a]] — A · 2 note(s) here, 5 in all\n- [[b]] — B · 2 note(s) here, 2 in all\n- [[c]] — C · 1 note(s) here, 2 in all\n\n"
    )
    values = spark.createDataFrame([(v,) for v in ("plain", "a: b", "", '-x"y', "two\nlines", " pad")], "v string").select(D.scalar(F.col("v")).alias("s"))
    assert [r["s"] for r in values.collect()] == ["plain", '"a: b"', '""', '"-x\\"y"', "two lines", '" pad"']
