"""The knowledge base over several runs, held against what a reader would expect of a small vault."""

import datetime as dt
import json

from pyspark.sql import functions as F

from newsloom.operators.build import Vault, build, daily_documents, dangling_document, due_concepts, index_document, preview, synthesize, write_electrons

DAY = dt.datetime(2024, 1, 20)
ARTICLE = "id long, title string, summary string, content_md string, category string, importance int, tags array<string>, entities array<struct<name:string,type:string>>, published timestamp_ntz, fetched_at timestamp_ntz, updated_at timestamp_ntz, source_name string, url string, classified boolean, status string, story_id long"
NOTE = "id long, note_type string, slug string, title string, category string, tags array<string>, wikilinks array<string>, frontmatter string, content string, content_hash string, created_at timestamp_ntz, updated_at timestamp_ntz"
OWN = "slug string, title string, content string, tags array<string>, wikilinks array<string>"


def article(i, title, tags=(), entities=(), **more):
    row = {"id": i, "title": title, "summary": "s", "content_md": "body", "category": "models", "importance": 3, "tags": list(tags), "entities": list(entities), "published": DAY, "fetched_at": DAY, "updated_at": DAY, "source_name": "wire", "url": f"https://x.example/{i}", "classified": True, "status": "unread", "story_id": 0} | more
    return tuple(row[c.split()[0]] for c in ARTICLE.split(", ") if c.split()[0] in row)


def rows(spark, data):
    return spark.createDataFrame(data, ARTICLE)


def empty(spark):
    return Vault(spark.createDataFrame([], NOTE), spark.createDataFrame([], "concept_slug string, note_id long, created_at timestamp_ntz"), spark.createDataFrame([], "slug string, name string, note_id long, mentions long, first_seen timestamp_ntz, last_seen timestamp_ntz"), spark.createDataFrame([("g-p-t", "gpt")], "alias string, canonical string"), spark.createDataFrame([], "ref_type string, ref_id string, note_id long, status string, created_at timestamp_ntz"))


def at(days):
    return F.lit(DAY + dt.timedelta(days=days)).cast("timestamp_ntz")


def test_build_takes_what_changed(spark):
    data = [
        article(1, "Mamba", ["state-space", "ai"], [("Mamba", "model"), ("Open AI", "org"), ("Ada", "place")]),
        article(2, "Another Mamba", ["State-Space"], [("Mamba", "model"), ("OpenAI", "org")]),
        article(3, "Mamba", ["g-p-t"]),
        article(4, "Not important", ["gpt"], importance=1),
        article(5, "Copy", ["gpt"], story_id=1),
    ]
    own = spark.createDataFrame([("my-note", "Mine", "see [[g-p-t]] and [[nowhere]]", ["t"], ["g-p-t", "nowhere"])], OWN)
    vault, counts = build(empty(spark), rows(spark, data), own, at(1))
    got = {r["what"]: r["n"] for r in counts.collect()}
    assert got == {"notes_imported": 1, "atoms_created": 3, "concepts_tracked": 4, "atoms_refreshed": 0, "electrons_created": 4, "electrons_updated": 0, "molecules_created": 0, "molecules_updated": 0}
    notes = {r["slug"]: r for r in vault.notes.collect()}
    # the concept has its name before the articles titled like it; spellings of one batch are one concept, in the first's name
    assert {s for s, r in notes.items() if r["note_type"] == "atom"} == {"mamba-2", "mamba-3", "another-mamba"}
    assert {s: r["title"] for s, r in notes.items() if r["note_type"] == "electron"} == {"mamba": "Mamba", "open-ai": "Open AI", "state-space": "State Space", "gpt": "G P T"}
    assert notes["mamba-2"]["wikilinks"] == ["mamba", "open-ai", "state-space"] and notes["another-mamba"]["wikilinks"] == ["mamba", "open-ai", "state-space"] and notes["mamba-3"]["wikilinks"] == ["gpt"]
    assert json.loads(notes["mamba-2"]["frontmatter"]) == {"category": "models", "rating": 3, "source": "wire", "tags": ["state-space", "ai"], "type": "atom", "url": "https://x.example/1"}
    assert "[[open-ai]]" in notes["mamba"]["content"] and "[[another-mamba]] — Another Mamba" in notes["mamba"]["content"]
    concepts = {r["slug"]: r for r in vault.concepts.collect()}
    assert {s: r["mentions"] for s, r in concepts.items()} == {"mamba": 2, "open-ai": 2, "state-space": 2, "gpt": 2} and all(r["note_id"] for r in concepts.values())
    assert {(r["ref_id"], r["status"]) for r in vault.ledger.collect()} == {("1", "processed"), ("2", "processed"), ("3", "processed")}
    assert sorted(r["id"] for r in notes.values()) == list(range(1, 9))

    # nothing changed: nothing is written
    again, counts = build(vault, rows(spark, data), own, at(2))
    assert {r["n"] for r in counts.collect()} == {0}
    assert {r["slug"]: tuple(r) for r in again.notes.collect()} == {s: tuple(r) for s, r in notes.items()}

    # an article that moved on, one whose change nobody would notice, and a new one
    data[0] = article(1, "Mamba", ["state-space", "ai"], [("Mamba", "model"), ("Open AI", "org")], summary="better", updated_at=DAY + dt.timedelta(days=2))
    data[1] = article(2, "Another Mamba", ["State-Space"], [("Mamba", "model"), ("OpenAI", "org")], updated_at=DAY + dt.timedelta(days=2), status="read")
    data.append(article(6, "Fresh", ["mamba", "lone"]))
    third, counts = build(again, rows(spark, data), own, at(3))
    got = {r["what"]: r["n"] for r in counts.collect()}
    assert got["atoms_created"] == 1 and got["atoms_refreshed"] == 1 and got["electrons_created"] == 0 and got["electrons_updated"] == 1 and got["notes_imported"] == 0
    notes = {r["slug"]: r for r in third.notes.collect()}
    assert "better" in notes["mamba-2"]["content"] and notes["another-mamba"]["updated_at"] == DAY + dt.timedelta(days=3) and "lone" not in notes
    assert notes["mamba"]["created_at"] == DAY + dt.timedelta(days=1) and "[[fresh]]" in notes["mamba"]["content"]

    # what a run would do, and the story of a category
    coming = preview(third, rows(spark, [*data, article(7, "Lone wolf", ["lone", "other"])]), own, at(4))
    assert {r["slug"]: (r["mentions"], r["after"], r["promoting"]) for r in coming["concepts"].collect()} == {"lone": (1, 2, True), "other": (0, 1, False)}
    assert [(r["slug"], r["concepts"]) for r in coming["atoms"].collect()] == [("lone-wolf", ["lone", "other"])] and {r["what"]: r["n"] for r in coming["counts"].collect()} == {"stale_atoms": 0, "notes_new": 0, "notes_edited": 0}
    told, written = synthesize(third, spark.createDataFrame([("models",), ("nothing",)], "category string"), at(5))
    assert [(r["slug"], r["outcome"]) for r in written.collect()] == [("sintesis-models", "created")]
    story = told.notes.where("slug = 'sintesis-models'").first()["content"]
    assert "# 🧪 Síntesis de models" in story and "- 2024-01-20 · [[mamba-2]] — Mamba\n" in story and "- [[mamba]] — Mamba · 3 note(s) here, 3 in all" in story
    again, written = synthesize(told, spark.createDataFrame([("models",)], "category string"), at(6))
    assert [r["outcome"] for r in written.collect()] == ["fresh"]

    # a reader asks for a note before a concept has earned it
    wanted = due_concepts(third, spark.createDataFrame([], "slug string"), explicit=spark.createDataFrame([("lone",), ("none",)], "slug string"))
    fourth, written = write_electrons(third, wanted, at(4))
    assert [(r["slug"], r["outcome"]) for r in written.collect()] == [("lone", "created")]
    assert {r["slug"]: r["note_id"] for r in fourth.concepts.collect()}["lone"] is not None

    text = index_document(third, at(3)).first()["document"]
    assert "5 atoms" not in text and "4 atoms · 4 electrons · 0 molecules · 1 concepts waiting for one" in text and "- [[lone]] — Lone · 1 mention(s) *(no note yet)*" in text and "### models\n- [[" in text
    assert "| [[lone]] | 1 | 2024-01-23 | 2024-01-23 |" in dangling_document(third.concepts, at(3)).first()["document"]
    days = {r["day"]: r["document"] for r in daily_documents(third.notes, spark.createDataFrame([(dt.date(2024, 1, 21), "All about snakes."), (dt.date(2024, 2, 1), "Quiet.")], "date date, overview string"), at(3)).collect()}
    assert set(days) == {"2024-01-21", "2024-01-23", "2024-02-01"} and "## Digest\nAll about snakes.\n\n## Notes added today\n- [[" in days["2024-01-21"] and "## Concepts that earned a note\n- [[gpt]]" in days["2024-01-21"]


def test_themes_become_molecules_and_keep_their_note(spark):
    data = [article(i, f"Report {i}", ["agents", "memory"]) for i in (1, 2, 3)] + [article(4, "Chips", ["chips"])]
    vault, counts = build(empty(spark), rows(spark, data), spark.createDataFrame([], OWN), at(1))
    assert {r["what"]: r["n"] for r in counts.collect()}["molecules_created"] == 1
    note = vault.notes.where("note_type = 'molecule'").first()
    assert note["slug"] == "theme-agents" and "[[report-1]]" in note["content"]
    more, counts = build(vault, rows(spark, [*data, article(9, "Report 9", ["agents", "memory"])]), spark.createDataFrame([], OWN), at(2))
    assert {r["what"]: r["n"] for r in counts.collect()} == {"notes_imported": 0, "atoms_created": 1, "concepts_tracked": 2, "atoms_refreshed": 0, "electrons_created": 0, "electrons_updated": 2, "molecules_created": 0, "molecules_updated": 1}
    after = more.notes.where("note_type = 'molecule'").collect()
    assert [r["id"] for r in after] == [note["id"]] and "[[report-9]]" in after[0]["content"]


def test_steps_without_input_write_no_tables(spark, monkeypatch):
    """Nor do the reader's notes that are as they were: most of a run's seconds are tables that are written, however small."""
    import newsloom.operators.build as B

    written, stored = [], B.stored
    monkeypatch.setattr(B, "stored", lambda df: written.append(1) or stored(df))
    own = spark.createDataFrame([("mine", "Mine", "see [[gpt]]", ["t"], ["gpt"])], OWN)
    vault, _ = build(empty(spark), rows(spark, [article(1, "Mamba", ["gpt"])]), own, at(1))
    first = len(written)
    again, counts = build(vault, rows(spark, [article(1, "Mamba", ["gpt"])]), own, at(2))
    assert {r["n"] for r in counts.collect()} == {0}
    assert again.notes is vault.notes and again.ledger is vault.ledger and len(written) - first <= 12
