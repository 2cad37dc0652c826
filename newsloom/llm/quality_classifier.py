"""Quality classifier: random-indexing word vectors pooled for each document, then a two-layer network.

A token is a run of letters, digits and characters beyond ASCII, or a run of other visible characters; it is
hashed to one of ``WORDS`` word slots. Each slot has a sparse random index vector; its context vector is the
sum of the index vectors of its neighbours over all documents, and its word vector is the index vector plus
the context vector at length one. A document is the mean and
the spread of its tokens' vectors, and how often neighbours are equal. The network
(numpy) is fitted to a bounded sample of labelled documents, and its temperature to a part of them kept back.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import held_out, joined, slices, table, text_bytes, with_arrow_columns

#: Word slots, dimensions, and non-zero entries (half 1, half -1) of an index vector.
WORDS, DIMENSIONS, ENTRIES = 1 << 14, 48, 4
THRESHOLD = 0.7
_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)

#: 0 white space and control characters, 1 letters, digits and bytes beyond ASCII, 2 other visible characters.
_KIND = np.array([1 if chr(b).isalnum() or b >= 128 else 0 if b <= 32 or b == 127 else 2 for b in range(256)], np.uint8)
_KIND[128:] = 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's multiplier and of its inverse modulo 2^64."""
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = 1 << max(21, int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", _INVERSE)):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                _POWERS[name] = np.cumprod(factors, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def token_slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word slots of all tokens in order, and how many tokens each text has."""
    data, _, ends = joined(texts, b"\n")
    kind = _KIND[data]
    change = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = change[kind[change] > 0]
    stops = change[kind[change - 1] > 0]
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        h = (total[stops] - total[starts]) * down[starts]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    slots = (h >> np.uint64(64 - WORDS.bit_length() + 1)).astype(np.int64)
    bounds = np.searchsorted(starts, ends)
    return slots, np.diff(np.concatenate([[0], bounds]))


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of each slot's index vector."""
    rng = np.random.default_rng(7)
    places = rng.random((WORDS, DIMENSIONS)).argpartition(ENTRIES, 1)[:, :ENTRIES]
    return places.astype(np.int64), np.tile(np.array([1, -1], np.int8), (WORDS, ENTRIES // 2))


def context_sums(docs: DataFrame) -> np.ndarray:
    """The context vector of each slot, over the tokens next to it on either side in every text.

    Tasks sum what they read, Spark sums by slot, and a table of WORDS rows reaches the driver.
    """

    def partial(batches):
        places, signs = index_vectors()
        total = np.zeros(WORDS * DIMENSIONS)
        for batch in batches:
            for _, some in slices(text_bytes(batch, "text")):
                slots, counts = token_slots(some)
                if len(slots) < 2:
                    continue
                within = np.ones(len(slots) - 1, bool)
                cut = np.cumsum(counts)[:-1]
                within[cut[(cut > 0) & (cut < len(slots))] - 1] = False
                left, right = slots[:-1][within], slots[1:][within]
                for word, neighbour in ((left, right), (right, left)):
                    for e in range(ENTRIES):
                        total += np.bincount(word * DIMENSIONS + places[neighbour, e], weights=signs[neighbour, e], minlength=WORDS * DIMENSIONS)
        rows = total.reshape(WORDS, DIMENSIONS)
        met = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array([r.tobytes() for r in rows[met].astype("<f4")], pa.binary())], ["slot", "sums"])

    def summed(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, sums in zip(batch.column("slot").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                total[slot] = total.get(slot, 0) + np.frombuffer(sums, "<f4").astype(float)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.astype("<f8").tobytes() for v in total.values()], pa.binary())], ["slot", "sums"])

    parts = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(partial, "slot int, sums binary")
    rows = parts.repartition("slot").mapInArrow(summed, "slot int, sums binary").collect()
    out = np.zeros((WORDS, DIMENSIONS))
    for row in rows:
        out[row["slot"]] = np.frombuffer(row["sums"], "<f8")
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    places, signs = index_vectors()
    own = np.zeros((WORDS, DIMENSIONS))
    np.put_along_axis(own, places, signs.astype(float), 1)
    length = np.linalg.norm(contexts, axis=1, keepdims=True)
    return (own / np.sqrt(ENTRIES) + contexts / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean and standard deviation of the token vectors of each text, and the share of neighbours that are equal; zeros without tokens."""
    d = DIMENSIONS
    sums, tokens = np.zeros((len(texts), 2 * d + 1)), np.zeros(len(texts))
    for owners, some in slices(texts):
        slots, counts = token_slots(some)
        ends = np.cumsum(counts)
        for i, a, b in zip(owners.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
            if b > a:
                met, n = np.unique(slots[a:b], return_counts=True)
                v = vectors[met].astype(float)
                sums[i] += np.concatenate([n @ v, n @ v**2, [np.count_nonzero(slots[a + 1 : b] == slots[a : b - 1])]])
                tokens[i] += b - a
    means = sums / np.maximum(tokens, 1)[:, None]
    means[:, d : 2 * d] = np.sqrt(np.maximum(means[:, d : 2 * d] - means[:, :d] ** 2, 0))
    return means


@dataclass
class Network:
    """Standardised features, one hidden layer (tanh), a logit over the temperature."""

    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 300, decay: float = 1e-3) -> Network:
    """Adam on the cross entropy of four fifths of the rows, the temperature on the rest."""
    rng = np.random.default_rng(3)
    order = rng.permutation(len(y))
    kept_back = order[: len(y) // 5]
    used = order[len(y) // 5 :] if len(y) >= 10 else order
    net = Network(x[used].mean(0), x[used].std(0) + 1e-3, rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0)
    z, target = (x[used] - net.centre) / net.scale, y[used]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    step, batch = 0, 256
    for _ in range(epochs):
        for at in np.array_split(rng.permutation(len(target)), max(1, len(target) // batch)):
            h = np.tanh(z[at] @ net.w1 + net.b1)
            error = 1 / (1 + np.exp(-np.clip(h @ net.w2 + net.b2, -40, 40))) - target[at]
            back = np.outer(error, net.w2) * (1 - h**2)
            grads = [z[at].T @ back / len(at) + decay * net.w1, back.mean(0), h.T @ error / len(at) + decay * net.w2, np.array([error.mean()])]
            step += 1
            moves = []
            for g, (m, v) in zip(grads, moments, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                moves.append(0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
            net.w1, net.b1, net.w2, net.b2 = net.w1 - moves[0], net.b1 - moves[1], net.w2 - moves[2], net.b2 - float(moves[3][0])
    rest = kept_back if len(y) >= 10 else used
    logits = net.logits(x[rest])
    losses = {t: np.mean(np.logaddexp(0, -np.where(y[rest] > 0, 1, -1) * logits / t)) for t in np.geomspace(0.25, 8, 60)}
    net.temperature = float(min(losses, key=losses.get))
    return net


@dataclass
class QualityClassifier:
    vectors: np.ndarray
    network: Network | None

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.round(self.network.probability(pooled(texts, self.vectors)), 12) if self.network else np.full(len(texts), 0.5)


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """About ``per_label`` labelled documents of each label outside the held-out fold, (doc_id, y, text).

    Labels are drawn by a hash of doc_id first, so the draw that is sent out to find the texts is bounded by
    2 * ``per_label``. A document whose labels differ has none; copies of a document count once.
    """
    own = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_most"))
    own = own.where(F.col("y") == F.col("_most")).select(F.col("doc_id").alias("_id"), "y")
    counts = {r["y"]: r["count"] for r in own.groupBy("y").count().collect()}
    rate = F.lit(0.0)
    for y in (0, 1):
        rate = F.when(F.col("y") == y, min(1.0, per_label / max(counts.get(y, 0), 1))).otherwise(rate)
    draw = F.pmod(F.xxhash64("_id", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    drawn = own.where(draw < rate)
    found = docs.join(F.broadcast(drawn), docs["doc_id"] == drawn["_id"]).select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))
    return found.dropDuplicates(["doc_id", "y"])


def fit_quality_classifier(docs: DataFrame, labels: DataFrame, per_label: int = 4000) -> QualityClassifier:
    """Context vectors over all ``docs``; the network from a bounded sample of ``labels``, of which pooled vectors reach the driver.

    Without a labelled document nothing is learned, and every score is a half.
    """
    vectors = word_vectors(context_sums(docs))
    sent = docs.sparkSession.sparkContext.broadcast(vectors)

    def make():
        own = sent.value
        return lambda batch: [pa.array([r.tobytes() for r in pooled(text_bytes(batch, "text"), own)], pa.binary())]

    rows = with_arrow_columns(labelled_sample(docs, labels, per_label), [T.StructField("x", T.BinaryType())], make, drop=("text",)).collect()
    if not rows:
        return QualityClassifier(vectors, None)
    rows = sorted((r["doc_id"], r["y"], bytes(r["x"])) for r in rows)
    x, y = np.stack([np.frombuffer(r[2]) for r in rows]), np.array([r[1] for r in rows], float)
    return QualityClassifier(vectors, fit_network(x, y))


def score_quality(docs: DataFrame, classifier: QualityClassifier) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` (1 from ``THRESHOLD`` on).

    Only the text is read, texts over ``SLICE_BYTES`` piece by piece. Null and empty texts get the score of a document without tokens; copies get equal
    scores; columns of the same names are replaced. The classifier's size doesn't depend on the input.
    """
    sent = docs.sparkSession.sparkContext.broadcast(classifier)

    def make():
        own = sent.value

        def compute(batch: pa.RecordBatch) -> list:
            scores = own.score(text_bytes(batch, "text"))
            return [scores, pa.array((scores >= THRESHOLD).astype(np.int32))]

        return compute

    return with_arrow_columns(docs, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], make)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classifier = fit_quality_classifier(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, classifier).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
