"""Names, merges and reconciled documents against what one after the other, or by hand, gives."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from newsloom.operators import graph as G
from newsloom.operators.reconcile import END, START, merged_text, reconcile_documents


@pytest.mark.parametrize("seed", [1])
def test_concept_names_equal_asking_in_order(spark, seed):
    rng = random.Random(seed)
    pool = [a + b for a in ("c", "d", "x") for b in ("", "-concept", "-concept-2", "-concept-3", "-concept-concept", "-concept-concept-2", "-concept-2-concept")]
    slugs, owned = rng.sample(pool, 15), {*rng.sample(pool, 5)} | {"z", "z-concept"} | {f"z-concept-{i}" for i in range(2, 11)}
    slugs.append("z")
    taken, want = set(), {}
    for slug in sorted(slugs):
        names = [slug, f"{slug}-concept", *[f"{slug}-concept-{i}" for i in range(2, 11)]]
        want[slug] = next((n for n in names if n not in owned and n not in taken), f"{slug}-concept")
        taken.add(want[slug])
    df = spark.createDataFrame([(s,) for s in [*slugs, slugs[0]]], "slug string").repartition(3)
    got = {r["slug"]: r["note_slug"] for r in G.allocate_concept_slugs(df, spark.createDataFrame([(o,) for o in owned], "slug string")).collect()}
    assert got == want and want["z"] == "z-concept"


@pytest.mark.parametrize("seed", [3])
def test_note_names_equal_asking_in_order(spark, seed):
    rng = random.Random(seed)
    bases = ["a", "a-2", "a-2-2", "a-3", "b", "note"]
    rows = [(i, rng.choice(bases) if i > 8 else "note") for i in range(60)]
    owned, tries = {"a", "a-2-3", "note-4"}, 6
    taken, want = set(), {}
    for i, base in rows:
        names = [base, *[f"{base}-{k}" for k in range(2, tries + 1)]]
        free = next((n for n in names if n not in owned and n not in taken), None)
        want[i] = free or f"{base}-{tries + 1}"
        taken |= {free}
    df = spark.createDataFrame(rows, "id long, slug string").repartition(4)
    got = {r["id"]: r["note_slug"] for r in G.allocate_note_slugs(df, spark.createDataFrame([(o,) for o in owned], "slug string"), tries).collect()}
    assert got == want


@pytest.mark.parametrize("seed", [5, 6])
def test_every_article_of_a_frequent_title_has_its_own_name(spark, seed):
    """More than 50 of a title, names of other titles in their way, and names that are taken before."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["note"] * 20 + ["note-7", "note-7-2", "note-7-2-3", "note-60", "note-61", "note-02", "b", "b-2", "b-3", "x-2"])) for i in rng.sample(range(1000), 250)]
    owned = {"note-3", "note-4", "note-5", "note-70", "b", "note-60-2", "x"}
    taken, want = set(owned), {}
    for i, base in sorted(rows):
        k = 1
        while (name := base if k == 1 else f"{base}-{k}") in taken:
            k += 1
        want[i] = name
        taken.add(name)
    df = spark.createDataFrame(rows, "id long, slug string").repartition(4)
    got = {r["id"]: r["note_slug"] for r in G.allocate_note_slugs(df, spark.createDataFrame([(o,) for o in owned], "slug string")).collect()}
    assert got == want and len(set(got.values())) == len(rows)


def test_chains_of_merges_end_and_circles_are_refused(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("p", "q"), ("q", "r"), ("r", "p"), ("in", "p"), ("s", "s"), ("m", "old"), ("t", "v"), ("t", "u"), (None, "x")]
    older = [("old", "new"), ("new", "newest"), ("a", "elsewhere"), ("v", "t2")]
    merges, refused = G.merge_plan(spark.createDataFrame(pairs, "from string, to string"), spark.createDataFrame(older, "alias string, canonical string"))
    assert {tuple(r) for r in merges.collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("m", "newest"), ("t", "u")}
    assert {r["from"] for r in refused.collect()} == {"p", "q", "r", "in", "s"}
    chain = [(f"n{i:03}", f"n{i + 1:03}") for i in range(100)]
    merges, refused = G.merge_plan(spark.createDataFrame(chain, "from string, to string"))
    assert {r["to"] for r in merges.collect()} == {"n100"} and refused.isEmpty()


def test_merged_notes(spark):
    rows = [(1, "n", "N", "see [[a]], [[a|that]], [[ab]], [[b]] and [[x]]", ["a", "b", "x"]), (2, "a", "A", "own [[x]]", ["x"]), (3, "o", "O", None, ["x"])]
    merges = spark.createDataFrame([("a", "x"), ("b", "x")], "from string, to string")
    notes = spark.createDataFrame(rows, "id long, slug string, title string, content string, wikilinks array<string>")
    out = {r["id"]: r for r in G.merged_notes(notes, merges, spark.createDataFrame([("x", "Ex")], "slug string, name string"), F.lit(dt.datetime(2024, 1, 2))).collect()}
    assert set(out) == {1, 2} and out[1]["content"] == "see [[x]], [[x|that]], [[ab]], [[x]] and [[x]]" and out[1]["wikilinks"] == ["x"]
    assert out[2]["change"] == "redirect" and out[2]["wikilinks"] == ["x"] and out[2]["content"].endswith("# A\n\nMerged into [[x]] — Ex.\n")


NEW = "---\ntype: atom\ntags:\n  - ai\n  - new\n---\n\n# Title\nbody\n"


def test_reader_text_properties_and_tags_stay():
    old = f'---\ntype: x\nreviewed: 2026-08-19\nnote: "a"\n  more\ntags:\n  - ai\n  - mine\n  - "two: words"\n  - gone\n---\nhead\n{START}\nstale\n{END}\n## My notes\n---\nnot a head\n---\n'
    want = f'---\ntype: atom\ntags:\n  - ai\n  - new\n  - mine\n  - "two: words"\nreviewed: 2026-08-19\nnote: "a"\n  more\n---\nhead\n{START}\n# Title\nbody\n{END}\n## My notes\n---\nnot a head\n---\n'
    assert merged_text(old, NEW, ["ai", "gone"]) == want
    assert merged_text(want, NEW, ["ai", "new"]) == want
    assert merged_text(f"{END}{START}", NEW, []) is None and merged_text("text", NEW, []) is None
    assert merged_text(f"{START}x{END}", "plain\n", []) == f"{START}\nplain\n{END}"
    assert merged_text(f"---\ntags:\n  - t\n---\n{START}{END}", "---\ntype: a\n---\nb\n", []) == f"---\ntype: a\ntags:\n  - t\n---\n{START}\nb\n{END}"


def test_reconciled_documents(spark):
    fresh = f"---\ntype: atom\ntags:\n  - ai\n  - new\n---\n{START}\n# Title\nbody\n{END}\n"
    rendered = spark.createDataFrame([(p, NEW) for p in ("none", "same", "edited", "bare", "adopted", "broken")] + [("empty", None)], "path string, text string")
    import hashlib

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    edited = fresh.replace("body", "changed") + "mine\n"
    stored = [("same", "as it was", digest("as it was"), None), ("edited", edited, "other", ["ai", "new"]), ("bare", "no markers", "other", None), ("adopted", "no markers", None, None), ("broken", START, "other", None)]
    out = {r["path"]: r for r in reconcile_documents(rendered, spark.createDataFrame(stored, "path string, text string, last_hash string, last_tags array<string>")).collect()}
    assert {p: r["outcome"] for p, r in out.items()} == {"none": "created", "same": "replaced", "edited": "merged", "bare": "kept", "adopted": "replaced", "broken": "kept", "empty": "created"}
    assert out["none"]["text"] == out["same"]["text"] == out["adopted"]["text"] == fresh and out["edited"]["text"] == fresh + "mine\n"
    assert out["bare"]["text"] == "no markers" and out["bare"]["hash"] == "other" and out["edited"]["hash"] == digest(fresh + "mine\n")
