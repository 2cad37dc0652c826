"""Language identification: the family first, then one-versus-one linear SVMs within it.

Features are hashed byte n-grams of the folded text (letters lower-cased, everything between words one
space). A multinomial model over language families takes the first decision; within the chosen family each
pair of languages has a linear support vector machine, and the language with most wins (then the larger sum
of margins, then the first name) is predicted. All decision functions are linear in n-gram frequencies, so a
text is scored by summing table rows, whatever its length.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import bounded_sample, held_out, joined, slices, table, text_bytes, with_arrow_columns

#: Families of ISO 639-1 codes; a code that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb yi",
    "romance": "es fr it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs mk bg",
    "indic": "hi ur bn pa gu mr ne si sa",
    "turkic": "tr az kk ky uz tt tk ug",
    "uralic": "fi et hu se",
    "semitic": "ar he mt am ti",
    "baltic": "lt lv",
    "celtic": "ga gd cy br",
    "iranian": "fa ps ku tg",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
BITS, ORDERS = 15, (2, 3, 4)
UNDETERMINED = "und"

_FOLD = np.full(256, 32, np.uint8)
for _b in range(256):
    if chr(_b).isascii() and chr(_b).isalpha():
        _FOLD[_b] = ord(chr(_b).lower())
    elif _b >= 0x80:
        _FOLD[_b] = _b


def ngram_slots(texts: list[bytes]) -> tuple[list[tuple[int, np.ndarray]], np.ndarray, np.ndarray]:
    """For each order the slot of the n-gram at each byte, and the first and last byte of each folded text, spaces around it included."""
    data, starts, ends = joined(texts)
    data = _FOLD[data]
    upper = np.flatnonzero(data[:-1] == 0xC3) + 1  # À to Þ
    upper = upper[(data[upper] >= 0x80) & (data[upper] <= 0x9E)]
    data[upper] += 0x20
    keep = np.ones(len(data), bool)
    keep[1:] = (data[1:] != 32) | (data[:-1] != 32)
    at = np.cumsum(keep) - 1
    data = data[keep].astype(np.uint32)
    code, out = data, []
    for n in range(2, max(ORDERS) + 1):
        code = code[:-1] * np.uint32(256) + data[n - 1 :] if n <= 4 else code
        if n in ORDERS:
            out.append((n, ((code + np.uint32(n)) * np.uint32(2654435761)) >> np.uint32(32 - BITS)))
    return out, at[starts - 1], at[ends]


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    first, last = np.minimum(first, len(values)), np.minimum(last, len(values))
    return total[np.maximum(last, first)] - total[first]


def _features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Slots and counts of each text."""
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in texts]
    for owners, some in slices(texts):
        orders, first, last = ngram_slots(some)
        for i, a, b in zip(owners.tolist(), first, last, strict=True):
            found[i].append(np.unique(np.concatenate([slot[a : max(a, b - n + 2)] for n, slot in orders]), return_counts=True))
    out = []
    for parts in found:
        slots, at = np.unique(np.concatenate([s for s, _ in parts]), return_inverse=True)
        out.append((slots, np.bincount(at, np.concatenate([n for _, n in parts]), len(slots))))
    return out


@dataclass
class LanguageModel:
    """``weights``: a row for each slot with a column for each family, then one for each pair of a family."""

    families: list[str]
    members: dict[str, list[str]]
    pairs: list[tuple[str, str]]
    weights: np.ndarray
    slopes: np.ndarray

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray]:
        sums, n_grams = np.zeros((len(texts), self.weights.shape[1])), np.zeros(len(texts))
        for owners, some in slices(texts):
            orders, first, last = ngram_slots(some)
            for n, slot in orders:
                end = np.maximum(last - n + 2, first)
                np.add.at(sums, owners, _sums(self.weights[slot], first, end))
                np.add.at(n_grams, owners, end - first)
        means = sums / np.maximum(n_grams, 1)[:, None]
        found = [self._decide(means[i], n_grams[i]) if self.families and has_letter(text) else (UNDETERMINED, 0.0) for i, text in enumerate(texts)]
        return [lang for lang, _ in found], np.array([score for _, score in found])

    def _decide(self, mean: np.ndarray, n_grams: float) -> tuple[str, float]:
        k = len(self.families)
        z = mean[:k] * min(n_grams, 100.0)  # n-grams overlap, so long texts aren't that much surer
        p = np.exp(z - z.max())
        p /= p.sum()
        family = self.families[int(np.argmax(p))]
        own = self.members[family]
        wins, margin, chance = dict.fromkeys(own, 0), dict.fromkeys(own, 0.0), {x: [] for x in own}
        for j, (a, b) in enumerate(self.pairs):
            if a in wins and b in wins:
                m = mean[k + j]
                q = 1 / (1 + np.exp(-np.clip(self.slopes[j] * m, -30, 30)))
                wins[a if m >= 0 else b] += 1
                for x, sign, c in ((a, 1, q), (b, -1, 1 - q)):
                    margin[x] += sign * m
                    chance[x].append(c)
        best = max(own, key=lambda x: (wins[x], margin[x]))
        return best, float(p.max() * (np.mean(chance[best]) if chance[best] else 1.0))


def has_letter(text: bytes) -> bool:
    if not text.isascii():
        return any(c.isalpha() for c in text.decode("utf-8", "replace"))
    return text.lower() != text.upper()


def _svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, c: float = 10.0, epochs: int = 40) -> np.ndarray:
    """Dual coordinate descent for the squared hinge loss. Returns the weights of plain n-gram frequencies.

    Training rows are frequencies over the square root of their mean, brought to length one.
    """
    mean = np.full(size, 1e-6)
    for i, n in rows:
        mean[i] += n / n.sum() / len(rows)
    scale = 1 / np.sqrt(mean)
    w, alpha, order = np.zeros(size), np.zeros(len(rows)), np.random.default_rng(0)
    unit = [(i, v / np.sqrt(v @ v)) for i, v in ((i, n * scale[i]) for i, n in rows)]
    for _ in range(epochs):
        most = 0.0
        for r in order.permutation(len(rows)):
            i, v = unit[r]
            g = y[r] * (w[i] @ v) - 1 + alpha[r] / (2 * c)
            new = max(alpha[r] - g / (1 + 1 / (2 * c)), 0.0)
            if new != alpha[r]:
                w[i] += (new - alpha[r]) * y[r] * v
                most = max(most, abs(new - alpha[r]))
                alpha[r] = new
        if most < 1e-3:
            break
    return w * scale


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """From (language, slots, counts) of each training text."""
    rows = [r for r in rows if len(r[1])]
    langs = sorted({r[0] for r in rows})
    members: dict[str, list[str]] = {}
    for lang in langs:
        members.setdefault(FAMILY_OF.get(lang, lang), []).append(lang)
    families, size = sorted(members), 1 << BITS
    pairs = [pair for f in families for pair in combinations(members[f], 2)]
    weights = np.zeros((size, len(families) + len(pairs)), np.float32)
    for j, f in enumerate(families):
        counts = np.full(size, 0.5)
        for lang, i, n in rows:
            if lang in members[f]:
                counts[i] += n / n.sum() * min(n.sum(), 3000)
        weights[:, j] = np.log(counts / counts.sum())
    slopes = np.ones(len(pairs))
    for j, (a, b) in enumerate(pairs):
        own = [r for r in rows if r[0] in (a, b)]
        y = np.array([1.0 if r[0] == a else -1.0 for r in own])
        w = _svm([(i, n) for _, i, n in own], y, size)
        m = np.array([w[i] @ n / n.sum() for _, i, n in own]) * y
        slopes[j] = 3 / max(np.median(np.abs(m)), 1e-9)  # the median text gets sigmoid(3)
        weights[:, len(families) + j] = w
    return LanguageModel(families, members, pairs, weights, slopes)


def fit_language_model(docs: DataFrame, per_language: int = 800, full_languages: int = 64) -> LanguageModel:
    """Learns from text and non-null ``lang`` of documents outside the held-out fold.

    Takes about ``per_language`` distinct whole texts of every language; of more than ``full_languages``
    languages, equal shares of as many texts as those would give, but at least 50 each. Only their n-gram counts
    reach the driver. Without a labelled text no language is learned.
    """
    own = docs.where(~held_out(F.col("doc_id")) & F.col("text").isNotNull()).select("lang", "text")
    sample = bounded_sample(own, "lang", "text", per_language, full_languages)

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            found = _features(text_bytes(batch, "text"))
            return [[i.astype(np.int32).tobytes() for i, _ in found], [n.astype(np.float32).tobytes() for _, n in found]]

        return compute

    fields = [T.StructField("slots", T.BinaryType()), T.StructField("counts", T.BinaryType())]
    rows = with_arrow_columns(sample, fields, make, drop=("text",)).collect()
    rows = sorted((r["lang"], bytes(r["slots"]), bytes(r["counts"])) for r in rows)
    return train([(lang, np.frombuffer(i, np.int32), np.frombuffer(n, np.float32).astype(float)) for lang, i, n in rows])


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (the probability of the family times the mean probability of its pairs).

    Null text, or text without a letter (so empty text too), and all text if no language was learned: ``und``
    with score 0. N-grams of texts over ``SLICE_BYTES`` are counted piece by piece. Equal texts get equal
    results; each row is judged alone. The model has 2^15 rows of a float for each family and pair, so what is
    sent out is bounded by the number of languages. Input columns named like a new one are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def compute(batch: pa.RecordBatch) -> list:
            langs, scores = own.predict(text_bytes(batch, "text"))
            return [pa.array(langs, pa.string()), np.clip(scores, 0, 1)]

        return compute

    return with_arrow_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(docs)
    out = identify_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
