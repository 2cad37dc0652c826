"""Near-duplicates, sharding, packing and the pipeline: each against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from newsloom.llm import simhash_dedup
from newsloom.llm.components import connected_components
from newsloom.llm.decontaminate import find_contamination
from newsloom.llm.packing import CAPACITY, pack, plan_bins
from newsloom.llm.registry import QUERIES
from newsloom.llm.sharding import assign_shards, write_shards
from newsloom.llm.url_filter import RULES, judge_urls

SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints):
    """Smallest key reachable, from (key, fingerprint) rows."""
    keys = defaultdict(list)
    for key, fp in prints:
        keys[fp].append(key)
    fps, root = list(keys), {}
    for fp in fps:
        if fp in root:
            continue
        todo, seen = [fp], {fp}
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in seen and (x ^ y).bit_count() <= 3:
                    seen.add(y)
                    todo.append(y)
        least = min(k for x in seen for k in keys[x])
        root |= dict.fromkeys(seen, least)
    return root


def test_near_duplicates_equal_brute_force(spark):
    out = QUERIES["op3_simhash_dedup"](spark, SF).collect()
    texts = dict(duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    prints = {k: fingerprint(t) for k, t in texts.items()}
    root = components(prints.items())
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in out} == {(k, f"{fp:016x}", root[fp]) for k, fp in prints.items()}


def test_near_duplicates_of_odd_texts(spark):
    texts = [None, "", " \n", "one", "ONE", "a b c d", "a b c d", "w " * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(6, "a b c d", "x"), (None, "", "x")], "doc_id long, text string, fp string")
    rows = simhash_dedup.near_duplicates(df).collect()
    assert len(rows) == 10
    got = {r["doc_id"]: r["component_id"] for r in rows}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, None: 0}
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_dense_groups_of_fingerprints(spark, monkeypatch):
    """More fingerprints under one key than a block, in clusters that only chains of links connect."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)
    rng = random.Random(0)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = set(base)
    for b in base:
        for _ in range(80):
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    links = [(r["a"] & (2**64 - 1), r["b"] & (2**64 - 1)) for r in simhash_dedup.fingerprint_links(df).collect()]
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = components([(f, f) for f in fps])
    groups = defaultdict(set)
    for f in fps:
        groups[find(f)].add(want[f])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame(chain + star + [(7, 7), (300, 300), (5, 4)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)}
    assert connected_components(df.limit(0)).count() == 0


def test_shards_fit_and_split_no_more_than_needed(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.randint(1, 90), "x") for i in range(500)] + [(None, None, "x"), (7, 20, "x"), (1000, 5000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long, shard string")
    out = assign_shards(df, limit=1000).collect()
    assert Counter((r["doc_id"], r["n_bytes"]) for r in out) == Counter((a, b) for a, b, _ in rows)
    sizes, stated = Counter(), {}
    for r in out:
        sizes[r["shard"], r["page"]] += r["n_bytes"] or 0
        stated[r["shard"], r["page"]] = r["shard_bytes"]
    assert dict(sizes) == stated
    assert all(n <= 1000 or sum(r["shard"] == s for r in out) == 1 for (s, _), n in sizes.items())
    for (s, _), n in sizes.items():
        if s and n <= 1000:
            parent = sum(b for (x, _), b in sizes.items() if x.startswith(s[:-1]))
            assert parent > 1000
    write_shards(assign_shards(df, limit=1000), str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert assign_shards(df.limit(0)).count() == 0


def test_repeated_keys_overflow_into_pages(spark):
    df = spark.createDataFrame([(1, 30)] * 200 + [(1, 900)] * 3 + [(2, 10)], "doc_id long, n_bytes long").repartition(5)
    out = assign_shards(df, limit=300).collect()
    sizes = Counter()
    rows = Counter()
    for r in out:
        sizes[r["shard"], r["page"]] += r["n_bytes"]
        rows[r["shard"], r["page"]] += 1
    assert len(out) == 204 and all(n <= 300 or rows[k] == 1 for k, n in sizes.items()) and len(sizes) < 60


def laid_out(plan):
    """(bin, offset, length) of every piece of a plan."""
    out = []
    for length, _, count, first, per, offset in plan.rows:
        out += [(first + i // per, offset + i % per * length, length) for i in range(count)]
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_plans_are_gapless_and_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = [np.minimum(CAPACITY, rng.lognormal(6, 1.2, 20_000).astype(int) + 1), rng.integers(1, CAPACITY + 1, 5_000), np.full(700, 1366), np.array([1, CAPACITY, 2049, 2049])][seed]
    histogram = Counter(lengths.tolist())
    places = laid_out(plan_bins(dict(histogram)))
    assert Counter(p[2] for p in places) == histogram
    used = defaultdict(int)
    for bin_, offset, length in places:
        assert offset == used[bin_]
        used[bin_] += length
    assert max(used.values()) <= CAPACITY
    least = max(-(-sum(k * v for k, v in histogram.items()) // CAPACITY), sum(v for k, v in histogram.items() if 2 * k > CAPACITY), -(-700 // 2) if seed == 2 else 0)
    assert len(used) <= 1.02 * least + 1


def test_pieces_equal_the_library(spark):
    texts = [t for (t,) in duckdb.connect().execute(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()] + [None, "", "word " * 9000, "<|endoftext|>x"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(0, texts[0], "x")], "doc_id long, text string, piece string").repartition(3)
    own, want = Tokenizer.from_file(VOCABULARY), Counter()
    for i, t in [*enumerate(texts), (0, texts[0])]:
        ids = np.array([*own.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), CAPACITY):
            want[i, k // CAPACITY, k, len(ids[k : k + CAPACITY]), zlib.crc32(ids[k : k + CAPACITY].tobytes())] += 1
    rows = pack(df, VOCABULARY).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    used = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= CAPACITY and len(used) <= 1.05 * sum(used.values()) / CAPACITY + 1
    assert pack(df.limit(0), VOCABULARY).count() == 0


def test_pipeline_stages_filter_what_came_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-1, "the that of " * 40, "en", "s", 1), (-1, "the that of " * 40, "en", "s", 1)], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    deduped = stages["simhash_dedup"](spark, docs.unionByName(extra), SF)
    assert deduped.columns == docs.columns
    texts = [(r["doc_id"], r["text"]) for r in docs.unionByName(extra).collect()]
    root = components([(k, fingerprint(t)) for k, t in texts])
    assert sorted(r["doc_id"] for r in deduped.collect()) == sorted(set(root.values()))
    clean = stages["decontamination"](spark, docs, SF)
    hit = {r["doc_id"] for r in QUERIES["op9_decontamination"](spark, SF).where("contaminated").collect()}
    assert clean.columns == docs.columns and hit and {r["doc_id"] for r in clean.collect()} == {k for k, _ in texts if k >= 0} - hit
    for name in ("quality_classifier", "quality_rules"):
        kept = stages[name](spark, docs, SF)
        assert kept.columns == docs.columns and 0.5 * docs.count() < kept.count() < docs.count()


def test_stages_leave_columns_named_like_theirs_alone(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumns({c: F.concat(F.lit("own "), "doc_id") for c in ("score", "kept", "items", "component_id")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, extra, SF)
        assert kept.columns == extra.columns, name
        assert kept.where("score <> concat('own ', doc_id) OR kept <> score OR items <> score OR component_id <> score").isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, extra, SF).count() >= docs.count()


def test_pipeline_runs(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(Counter(r["sequence_id"] for r in rows).values()) > 1
    total = Counter()
    for r in rows:
        total[r["sequence_id"]] += r["length"]
    assert max(total.values()) <= CAPACITY


def test_columns_named_like_inner_ones_stay(spark):
    names = "_a _n _c _cell _bytes _part prefix bytes fp _fp _root _least _host _path _slots _action _runs items score shard fingerprint".split()
    df = spark.createDataFrame([(i, f"some text {i}", f"http://x{i}.org/a", 10 + i, *[f"{n}{i}" for n in names]) for i in range(6)], "doc_id long, text string, url string, n_bytes long, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "some text 3"), (2, "other words")], "item_id long, text string")
    results = {
        "shard": assign_shards(df, limit=20),
        "overflow": assign_shards(df.withColumn("doc_id", F.lit(1)), limit=20),
        "simhash": simhash_dedup.near_duplicates(df),
        "url": judge_urls(df, RULES, [0.0] * (1 << 15)),
        "bench": find_contamination(df, bench, block_bytes=10),
    }
    for name, out in results.items():
        rows = out.collect()
        assert len(rows) == 6, name
        for n in names:
            if not (n, name) in {("shard", "shard"), ("shard", "overflow"), ("fingerprint", "simhash"), ("score", "url"), ("items", "bench")}:
                assert sorted(r[n] for r in rows) == [f"{n}{i}" for i in range(6)], (name, n)


def test_many_components_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"w{k // 2} x y z " * 9) for k in range(40)], "doc_id long, text string")
    want = sorted(map(tuple, simhash_dedup.near_duplicates(docs).collect()))
    monkeypatch.setattr(simhash_dedup, "SENT_ROOTS", 0)
    assert sorted(map(tuple, simhash_dedup.near_duplicates(docs).collect())) == want
