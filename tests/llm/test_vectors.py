"""Vector codes and exact top-k against brute force, with nulls, copies, ties, repeated keys and clashing names."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm.top_k import top_inner_products
from newsloom.llm.vector_codes import Orchard, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string"


def _rows(n, size, seed, copies=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(size=size)], int(rng.integers(3)), "a", "b") for i in rng.permutation(n)]
    same = [float(np.float32(x)) for x in rng.normal(size=size) * 2]
    return rows + [(n + i, same, None, "c", "d") for i in range(copies)]


def _whole(rows):
    return np.floor(np.array([r[1] for r in rows], float) * 1024).astype(np.int64)


def test_orchard_finds_the_first_of_the_nearest():
    rng = np.random.default_rng(5)
    for spread, k in ((3, 40), (50, 256), (1000, 100), (1, 7), (9, 1)):
        entries, points = rng.integers(-spread, spread + 1, (k, 6)), rng.integers(-spread, spread + 1, (3000, 6))
        entries[-1] = entries[0]
        distances = ((points[:, None] - entries[None]) ** 2).sum(2)
        index, distance = Orchard(entries).nearest(points)
        assert (index == distances.argmin(1)).all() and (distance == distances.min(1)).all()


def _codes(rows, parts=4, k=256, rounds=4):
    """Brute force over rows in the order of their keys."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0], r[1]))
    whole = _whole(rows)
    cuts = np.array_split(whole, parts, axis=1)
    books = [c[:k].copy() for c in cuts]
    near = lambda x, b: ((x[:, None] - b[None]) ** 2).sum(2)
    for _ in range(rounds):
        for x, b in zip(cuts, books, strict=True):
            at = near(x, b).argmin(1)
            for e in np.unique(at):
                b[e] = x[at == e].sum(0) // (at == e).sum()
    codes, error = [""] * len(rows), np.zeros(len(rows), np.int64)
    for x, b in zip(cuts, books, strict=True):
        d = near(x, b)
        codes = [c + f"{e:02x}" for c, e in zip(codes, d.argmin(1), strict=True)]
        error += d.min(1)
    sha = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()
    of = {lab: int(sum(e for r, e in zip(rows, error, strict=True) if r[2] == lab)) for lab in {r[2] for r in rows}}
    return sorted((str(r[0]), c, int(e), of[r[2]], sha) for r, c, e in zip(rows, codes, error, strict=True))


@pytest.mark.parametrize("n, copies", [(700, 300), (100, 5), (1, 0)])
def test_vector_codes_equal_brute_force(spark, n, copies):
    rows = _rows(n, 8, n, copies)
    bad = [(-1, None, 1, "", ""), (-2, [float("nan")] * 8, 1, "", ""), (-3, [1.0] * 7 + [float("inf")], 1, "", ""), (-4, [None] * 8, 1, "", "")]
    odd = [(None, rows[0][1], 2, None, None), rows[0], rows[0]] if n > 1 else []
    df = spark.createDataFrame(rows + bad + odd, SCHEMA).repartition(5)
    got = vector_codes(df)
    assert got.columns == ["vec_id", "label", "v", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got.collect()) == _codes(rows + odd)


def test_vector_codes_of_other_sizes_and_no_rows(spark):
    rows = _rows(20, 8, 3)
    df = spark.createDataFrame([*rows, (50, [1.0, 2.0], 1, "", ""), (51, [], 1, "", "")], SCHEMA)
    assert vector_codes(df).count() == 20
    assert vector_codes(df.where("vec_id = 51")).select("code", "error").collect() == [("00000000", 0)]
    assert vector_codes(df.where("false")).count() == 0
    with pytest.raises(ArithmeticError):
        vector_codes(spark.createDataFrame([(1, [1e30] * 8, 1, "", "")], SCHEMA))


def _top(rows, k):
    whole, out = _whole(rows), []
    for i, q in enumerate(rows):
        if q[0] is not None and q[0] % 100 == 0:
            scores = whole @ whole[i]
            order = sorted((-int(s), r[0] is None, r[0] or 0) for j, (s, r) in enumerate(zip(scores, rows, strict=True)) if j != i)[:k]
            out += [(q[0], n + 1, None if none else v, -s) for n, (s, none, v) in enumerate(order)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bins, few, k", [(4, 4, 10), (256, 64, 3)])
def test_top_k_equals_brute_force(spark, bins, few, k):
    rows = _rows(900, 8, 1, copies=400)
    rows += [(100, rows[0][1], 1, "", ""), (100, rows[-1][1], 1, "", ""), (100, rows[-1][1], 1, "", ""), (None, rows[-1][1], 1, "", ""), (-300, rows[5][1], 1, "", "")]
    rows += [(5, rows[-1][1], 1, "", "")] * 30
    bad = [(200, None, 1, "", ""), (1000, [float("nan")] * 8, 1, "", ""), (1100, [None] * 8, 1, "", ""), (1200, [1.0] * 3, 1, "", "")]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumnRenamed("code", "score").repartition(6)
    got = top_inner_products(df, F.col("vec_id") % 100 == 0, k=k, bins=bins, few=few)
    assert sorted(map(tuple, got.collect()), key=str) == _top(rows, k)


def test_top_k_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, "", ""), (1, [3.0, -1.0], 1, "", ""), (100, [], 1, "", "")], SCHEMA)
    assert [tuple(r) for r in top_inner_products(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 1024)]
    assert top_inner_products(df.where("false"), F.lit(True)).count() == 0
    assert top_inner_products(df, F.lit(False)).count() == 0
    with pytest.raises(ArithmeticError):
        top_inner_products(spark.createDataFrame([(0, [1e30, 1e30], 1, "", "")], SCHEMA), F.lit(True))
