"""The language model and the bands of the quality rules against brute force over dictionaries."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from newsloom.llm import ngram_model
from newsloom.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"
N = ngram_model.ORDER


def classes(text):
    words = re.findall(r"[^\x00\x20\x09-\x0D]+", text or "")
    flat = "".join(w + " " for w in words).lower()
    return [0] * (N - 1) + [ord(c) if ord(c) < 2048 else 2048 + (ord(c) * 0x9E3779B97F4A7C15 % 2**64 >> 53) for c in flat]


def grams(text):
    c = classes(text)
    return [tuple(c[i : i + N]) for i in range(len(c) - N + 1)]


def kneser_ney(counts):
    """p of every n-gram of the highest order, by the textbook's recursion."""
    levels = {N: counts}
    for k in range(N - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    total = sum(levels[1].values()) + 0.5 * len(levels[1])
    p = {g: (n + 0.5) / total for g, n in levels[1].items()}
    for k in range(2, N + 1):
        often = Counter(levels[k].values())
        n1, n2, n3, n4 = (max(1, often[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        d = [min(max(x, 0.05 * i), 0.95 * i) for i, x in enumerate(raw, 1)]
        size, taken = Counter(), defaultdict(float)
        for g, n in levels[k].items():
            size[g[:-1]] += n
            taken[g[:-1]] += d[min(n, 3) - 1]
        p = {g: (n - d[min(n, 3) - 1] + taken[g[:-1]] * p[g[1:]]) / size[g[:-1]] for g, n in levels[k].items()}
    return p


def expected(docs):
    """Log perplexities of (text, lang) rows."""
    counts = defaultdict(Counter)
    for text, lang in docs:
        counts["=" + (lang or "other")].update(grams(text))
        counts["every"].update(grams(text))
    models = {k: kneser_ney(c) for k, c in counts.items() if c}
    out = []
    for text, lang in docs:
        own = "=" + (lang or "other")
        n, w = len(re.findall(r"[^\x20\x09-\x0D]+", text or "")), sum(counts[own].values())
        w /= w + ngram_model.PRIOR_GRAMS
        total = sum(math.log(w * models[own][g] + (1 - w) * models["every"][g]) for g in grams(text))
        out.append(-total / n if n else None)
    return out


def bands(rows):
    """Bands by language from (lang, log perplexity) of documents that pass the plain rules."""
    found = {}
    for lang in {x for x, _ in rows}:
        steps = sorted(math.floor(v * Q.STEPS + 0.5) for x, v in rows if x == lang)
        q1, q3 = (steps[math.ceil(q * len(steps)) - 1] / Q.STEPS for q in (0.25, 0.75))
        found[lang] = len(steps), (q1 + q3) / 2, q3 - q1
    n = sum(f[0] for f in found.values())
    middle, spread = (sum(f[0] * f[k] for f in found.values()) / n for k in (1, 2))
    out = {}
    for lang, (k, m, s) in found.items():
        m = (k * m + Q.PRIOR_MIDDLE * middle) / (k + Q.PRIOR_MIDDLE)
        s = max((k * s + Q.PRIOR_SPREAD * spread) / (k + Q.PRIOR_SPREAD), Q.LEAST_SPREAD)
        out[lang] = m - (Q.LOWER + 0.5) * s, m + (Q.UPPER + 0.5) * s
    return out


@pytest.mark.parametrize("block, chars", [(1 << 24, 1 << 20), (3000, 700)])
def test_perplexities_and_verdicts_equal_brute_force(spark, monkeypatch, block, chars):
    own = duckdb.connect().execute(f"SELECT text, lang FROM '{SF}/documents.parquet' WHERE doc_id % 12 = 1 AND len(text) < 2500 ORDER BY doc_id").fetchall()
    noise = random.Random(1)
    own += [(" ".join("".join(noise.choices("qzxj#0%;)日本", k=6)) for _ in range(80)), "en"), (None, None), ("", "en"), (" \n", None), ("a\0b É ÉÉ 😀", None), ("one text " * 40, "sv")]
    own += own[:3]
    monkeypatch.setattr(ngram_model, "BLOCK_BYTES", block)
    monkeypatch.setattr(ngram_model, "PASS_CHARS", chars)
    docs = spark.createDataFrame([(i, t, x, 1.5) for i, (t, x) in enumerate(own)], "doc_id int, text string, lang string, log_perplexity double").repartition(3).checkpoint()
    got = {r["doc_id"]: r for r in Q.apply_rules(docs).collect()}
    want = expected(own)
    assert len(got) == len(own)
    for i, value in enumerate(want):
        assert (got[i]["log_perplexity"] is None) == (value is None)
        assert value is None or math.isclose(got[i]["log_perplexity"], value, rel_tol=1e-6), i
    passed = [(own[i][1] or "other", want[i]) for i in got if not got[i]["base_failed"]]
    edges = bands(passed)
    verdicts = {i: not got[i]["base_failed"] and edges[own[i][1] or "other"][0] <= want[i] <= edges[own[i][1] or "other"][1] for i in got}
    assert {i: r["kept"] for i, r in got.items()} == verdicts
    assert not verdicts[len(own) - 9] and sum(verdicts.values()) > 30


def test_both_bands_reject_junk(spark):
    out = Q.op8_quality_rules(spark, SF).toPandas()
    rows = duckdb.connect().execute(f"SELECT doc_id, quality, text FROM '{SF}/documents.parquet' JOIN '{SF}/labels.parquet' USING (doc_id)").df()
    rows = rows.merge(out, on="doc_id")
    junk = rows[(rows.quality == 0) & ~rows.base_failed]
    tables = junk.text.str.contains("|", regex=False)
    assert (~junk[~tables].kept).mean() > 0.9 and (~junk[tables].kept).mean() > 0.4
    good = rows[(rows.quality == 1) & ~rows.base_failed]
    assert good.kept.mean() > 0.97
    middle = out[~out.base_failed].log_perplexity.median()
    rejected = junk[~junk.kept].log_perplexity
    assert (rejected < middle).any() and (rejected > middle).any()


def test_more_languages_than_are_sent_are_joined(spark, monkeypatch):
    monkeypatch.setattr(Q, "SENT_LANGUAGES", 0)
    docs = spark.createDataFrame([("some words here " * 30, "en", 1), (None, None, 2)], "text string, lang string, _band int").checkpoint()
    got = Q.apply_rules(docs)
    assert got.columns[:3] == docs.columns and sorted((r["_band"], r["kept"]) for r in got.collect()) == [(1, False), (2, False)]
