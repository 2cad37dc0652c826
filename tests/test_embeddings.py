"""Embedding runs against asking one document after the other."""

import random

import pytest

from newsloom.operators.embeddings import EmbedResult, embed_missing, read_vectors


@pytest.mark.parametrize("seed", [2])
def test_a_run_stops_where_the_serial_one_would_and_the_next_takes_what_is_left(spark, tmp_path, seed):
    rng = random.Random(seed)
    bad = {("article", i) for i in range(300) if rng.random() < 0.5} | {("note", i) for i in range(0, 40, 3)}
    docs = [(k, i, f"{k} {i} {'bad' if (k, i) in bad else ''}") for k, n in (("article", 300), ("note", 40)) for i in range(n)]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "kind string, id long, text string").repartition(5)

    def fn(texts):
        if texts.str.endswith("bad").any():
            raise ValueError("no")
        return [[1.0] for _ in texts]

    def serial(stored, most):
        new, failed = set(), 0
        for kind in ("note", "article"):
            streak = 0
            for k, i, text in sorted(docs):
                if k != kind or (k, i) in stored:
                    continue
                if text.endswith("bad"):
                    streak, failed = streak + 1, failed + 1
                    if streak >= most:
                        return new, failed, True
                else:
                    streak = 0
                    new.add((k, i))
        return new, failed, False

    for run, most in ((1, 4), (2, 7), (3, 1000)):
        before = {(r["kind"], r["id"]) for r in read_vectors(spark, str(tmp_path)).collect()}
        new, failed, stopped = serial(before, most)
        assert embed_missing(df, fn, str(tmp_path), run, size=3, most_failures=most, wave=16, largest=64) == EmbedResult(len(new), failed, stopped)
        assert {(r["kind"], r["id"]) for r in read_vectors(spark, str(tmp_path)).collect()} == before | new
    assert embed_missing(df.limit(0), fn, str(tmp_path), 4) == EmbedResult(0, 0, False)
