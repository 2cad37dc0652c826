"""Spelling variants against brute force, with nulls, repeats, long texts, accents and repeated letters."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from newsloom.llm import spelling
from newsloom.llm.spelling import rarest_disjoint, runs, signature, spelling_variants


def _near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _brute(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = defaultdict(list)
    for a in words:
        for b in words:
            if _near(a, b):
                near[a].append((-words[b], b))
    form = {w: min(near[w])[1] for w in words if near[w] and -min(near[w])[0] >= 5 * words[w]}
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return sorted(out)


@pytest.mark.parametrize("letters, block", [("ab", 4), ("abcdeéÈß÷", 512), ("a", 2)])
def test_variants_equal_brute_force(spark, monkeypatch, letters, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    rng = random.Random(letters)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 11))) for _ in range(120)]
    words = base + [b[:i] + rng.choice([*letters, ""]) + b[i + rng.randint(0, 1) :] for b in base for i in (0, 2, len(b) - 1)]
    weights = [rng.choice((1, 1, 1, 6, 40, 300)) for _ in words]
    rows = [(i % 90, rng.choice((" ", ", ", "\n1")).join(rng.choices(words, weights, k=70)).replace("ab", rng.choice(("ab", "AB")))) for i in range(150)]
    rows += [(None, rows[0][1]), (None, None), (7, ""), (8, "1234 ..."), rows[3], rows[3], (9, " ".join(words) + " x" * 5000)]
    df = spark.createDataFrame([(d, t, "w", "f", 1) for d, t in rows], "doc_id long, text string, word string, form string, n int").repartition(4)
    got = sorted(map(tuple, spelling_variants(df).collect()), key=lambda r: r[0])
    assert got == _brute(rows) and got and (len(letters) == 1 or any(r[1] for r in got))


def test_no_words_give_no_rows(spark):
    schema = "doc_id long, text string"
    assert spelling_variants(spark.createDataFrame([], schema)).count() == 0
    assert spelling_variants(spark.createDataFrame([(1, None), (2, ""), (3, "short words here")], schema)).count() == 0


def test_long_texts_are_cut_where_a_run_ends():
    text = "Abc déf " * 300 + "x" * 1000 + " end"
    assert runs(text, 7) == runs(text) == Counter({"abc": 300, "déf": 300, "x" * 1000: 1, "end": 1})


def test_pivots_are_the_rarest_that_do_not_overlap():
    assert rarest_disjoint([0, 1, 2], [5, 1, 5]) == [0, 2]
    assert rarest_disjoint([0, 1, 3, 4], [9, 1, 8, 2]) == [1, 3]
    rng = random.Random(3)
    for _ in range(200):
        places = sorted(rng.sample(range(12), rng.randint(3, 8)))
        weights = [rng.randint(1, 9) for _ in places]
        chosen = rarest_disjoint(places, weights)
        least = min(weights[i] + weights[j] for i in range(len(places)) for j in range(i) if places[i] - places[j] >= 2)
        assert sum(weights[i] for i in chosen) == least and places[chosen[1]] - places[chosen[0]] >= 2


def test_prefix_holds_all_places_of_its_last_bigram():
    order = {"aa": (0, 1), "ab": (1, 2), "ba": (2, 9)}
    last, prefix, _ = signature("aababab", order)
    assert last == 1 and prefix == [("aa", 0), ("ab", 1), ("ab", 3), ("ab", 5)]
