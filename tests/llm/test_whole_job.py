"""Cases in which an operator once did less than its whole job."""

import random

import corpus_pipeline
from newsloom.llm import quality_rules
from newsloom.llm.common import bounded_sample

SF = "/root/testdata/sf0.001"


def prose(seed, n=60):
    return " ".join(f"w{(seed * 7919 + i * i * 31) % 4999}" for i in range(n))


def test_dedup_leaves_one_document_of_each_group_whatever_its_ids(spark):
    rows = [(None, prose(k), None, None, None) for k in range(5)] + [(None, prose(0), "en", "s", 1)]  # unlike, then a copy
    rows += [(5, prose(10), "en", "s", 1), (5, prose(11), "en", "s", 1), (7, prose(11), "en", "s", 1), (4, prose(12), "en", "s", 1), (5, prose(12), None, "s", 1)]
    rows += [(None, prose(13), "en", "s", 1), (9, prose(13), "en", "s", 1), (None, None, "en", "s", 1), (None, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    got = sorted((r["text"] or "", r["doc_id"] or 0) for r in kept.collect())
    assert got == sorted([(prose(k), 0) for k in range(5)] + [(prose(10), 5), (prose(11), 5), (prose(12), 4), (prose(13), 9), ("", 0)])


def test_small_and_unlisted_languages_have_models_and_bands(spark):
    clean = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en' AND n_chars > 1000").orderBy("doc_id").limit(80).collect()]
    draw = random.Random(1)
    noise = " ".join("".join(draw.choices("qzxj#0%;)", k=draw.randint(4, 9))) for _ in range(300))
    rows = [(k, t, "en") for k, t in enumerate(clean[:60])] + [(k, t, "sv") for k, t in enumerate(clean[60:], 60)]
    rows += [(100, noise, "sv"), (101, noise[1:], "tlh"), (102, noise[2:], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert [(k, got[k]["log_perplexity"]) for k in (100, 101, 102) if got[k]["base_failed"] or got[k]["kept"]] == []
    passed = [r["kept"] for k, r in got.items() if 60 <= k < 100 and not r["base_failed"]]
    assert len(passed) > 10 and sum(passed) >= 0.8 * len(passed)


def test_samples_count_distinct_texts_of_every_label(spark):
    rows = [("hot", "copy")] * 20_000 + [("hot", prose(k, 4)) for k in range(50)] + [(f"l{k}", f"text {k}") for k in range(80)] + [(None, "no label")]
    df = spark.createDataFrame(rows, "lang string, text string")
    got = [(r["lang"], r["text"]) for r in bounded_sample(df, "lang", "text", 800, 64).collect()]
    assert sorted(got) == sorted({r for r in rows if r[0]})
