"""Quality rules: n-gram perplexity bands by language, beside plain rules on words.

A document's log perplexity is the mean negative log probability of its words, each with the space behind it, under
its language's character n-gram model (``ngram_model``). A document is rejected if it is outside its language's
band: above it the words are made of what the language doesn't have (symbols stuck to them, noise), below it
they are shorter and more alike than a text's (tables, separators, lists). Bands are set from the quartiles over
all documents of the language, drawn towards those of all languages as if by ``PRIOR_MIDDLE`` and ``PRIOR_SPREAD``
documents: the fewer a language has, the more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import checkpointed, release, table, text_bytes
from newsloom.llm.ngram_model import OTHER, BlockModel, block_log_probabilities, numbered_blocks

#: Band: lower quartile minus, upper quartile plus so many interquartile ranges, of at least ``LEAST_SPREAD``.
LOWER, UPPER, LEAST_SPREAD = 1.75, 3.0, 0.1
#: How many documents all languages count for beside a language's own, for its band's middle and its spread.
PRIOR_MIDDLE, PRIOR_SPREAD = 5, 50
#: Quartiles are taken of log perplexities in steps of one of so many parts.
STEPS = 1000
#: Bands of so many languages are sent to every task; of more they are joined.
SENT_LANGUAGES = 10_000
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOL_CHARACTERS = b"#*$%&|<>"


def word_statistics(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text; words end at ASCII white space."""
    words = text.split()
    bare = text.translate(None, _SPACE)
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "surrogatepass"))
    symbols = len(text) - len(text.translate(None, _SYMBOL_CHARACTERS))
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words inside windows of ``size`` words that occur twice or more."""
    if len(words) <= size:
        return 0
    ids: dict[bytes, int] = {}
    code = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    window, n = code, len(ids)
    for k in range(1, size):
        if n * len(ids) >= 1 << 62:
            _, window = np.unique(window, return_inverse=True)
            n = len(window)
        window, n = window[:-1] * len(ids) + code[k:], n * len(ids)
    _, at, often = np.unique(window, return_inverse=True, return_counts=True)
    hit = np.zeros(len(words), bool)
    again = often[at] > 1
    for k in range(size):
        hit[k : k + len(again)] |= again
    return int(hit.sum())


_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [T.StructField("log_perplexity", T.DoubleType())]


def measure(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` (text, lang and any other columns) with word statistics and ``log_perplexity``; columns of these names are replaced.

    Rows travel in compressed parts of their block to where the block's n-grams and their log probabilities are.
    """
    new = {f.name.lower() for f in _FIELDS}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new and f.name not in drop]
    names = [f.name for f in kept]
    rows = docs.select("text", "lang", *[c for c in names if c not in ("text", "lang")])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in numbered_blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
                out.write_batch(batch)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "part"])

    def score(parts: pa.Table, values: pa.Table) -> pa.Table:
        release()
        model, out = BlockModel(values), []
        for part in parts["part"]:
            for batch in pa.ipc.open_stream(part.as_buffer()):
                texts = text_bytes(batch, "text")
                found = [word_statistics(t) for t in texts]
                n_words = np.array([s[0] for s in found])
                total = model.log_probabilities(texts, batch.column("lang").to_pylist())
                perplexity = pa.array(-total / np.maximum(n_words, 1), mask=n_words == 0)
                columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                out.append(pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns + [perplexity], names + [f.name for f in _FIELDS]))
        return pa.Table.from_batches(out)

    packed = rows.mapInArrow(pack, "block long, part binary")
    return packed.groupBy("block").cogroup(block_log_probabilities(docs).groupBy("block")).applyInArrow(score, T.StructType(kept + _FIELDS))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def language_of(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(OTHER))


def fit_bands(measured: DataFrame) -> DataFrame:
    """(lang, low, high): bands from the quartiles of log perplexity over all documents that pass the plain rules.

    Quartiles come from counts by language and step. The middle and the spread of a language's quartiles are averaged
    with the means of all languages, by its number of documents beside ``PRIOR_MIDDLE`` and ``PRIOR_SPREAD``.
    """
    passed = measured.where(~base_failed() & F.col("log_perplexity").isNotNull())
    steps = passed.groupBy(language_of(F.col("lang")).alias("lang"), F.round(F.col("log_perplexity") * STEPS).cast("long").alias("step")).agg(F.count("*").alias("n"))
    own, upto = Window.partitionBy("lang"), Window.partitionBy("lang").orderBy("step")
    counted = steps.select("lang", "step", F.sum("n").over(upto).alias("upto"), F.sum("n").over(own).alias("n"))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("step"))) / STEPS
    found = checkpointed(counted.groupBy("lang").agg(F.max("n").alias("n"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3")).select("lang", "n", ((F.col("q1") + F.col("q3")) / 2).alias("middle"), (F.col("q3") - F.col("q1")).alias("spread")))
    share = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    every = found.agg(share("middle").alias("middle"), share("spread").alias("spread")).first()
    drawn = lambda c, weight: (F.col("n") * F.col(c) + weight * F.lit(every[c])) / (F.col("n") + weight)
    spread = F.greatest(drawn("spread", PRIOR_SPREAD), F.lit(LEAST_SPREAD))
    middle = drawn("middle", PRIOR_MIDDLE)
    return found.select("lang", (middle - (LOWER + 0.5) * spread).alias("low"), (middle + (UPPER + 0.5) * spread).alias("high"))


def with_verdict(measured: DataFrame, bands: DataFrame) -> DataFrame:
    """``measured`` with ``base_failed`` and ``kept``: not failed by the plain rules, and inside its language's band."""
    bands = checkpointed(bands.select(F.col("lang").alias("_band_lang"), "low", "high").select("_band_lang", F.struct("low", "high").alias("_band")))
    clash = {c: f"_in_{c}" for c in measured.columns if c.lower() in ("_band_lang", "_band")}
    own = measured.withColumnsRenamed(clash)
    side = F.broadcast(bands) if bands.count() <= SENT_LANGUAGES else bands
    joined = own.join(side, language_of(F.col("lang")) == F.col("_band_lang"), "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("_band.low"), F.col("_band.high")), F.lit(False))
    kept = [F.col(clash.get(c, c)).alias(c) for c in measured.columns if c.lower() not in ("base_failed", "kept")]
    return joined.select(*kept, base_failed().alias("base_failed"), (~base_failed() & inside).alias("kept"))


def apply_rules(docs: DataFrame, narrow: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with word statistics, ``log_perplexity``, ``base_failed`` and ``kept``; with ``narrow``, only those of its own columns.

    Null and empty texts have no words: they fail the plain rules, and their log perplexity is null. Null languages
    share the model and band of one named ``OTHER``. Copies and ties get equal verdicts; texts of any length are
    read whole; columns of the same names are replaced; empty tables give empty results. ``docs`` is read twice
    and must have its rows in the same partitions both times, as files and checkpoints have.
    """
    drop = () if narrow is None or "text" in narrow else ("text",)
    measured = checkpointed(measure(docs.select("text", "lang", *[c for c in narrow if c not in ("text", "lang")]) if narrow else docs, drop))
    return with_verdict(measured, fit_bands(measured))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(table(spark, sf_dir, "documents"), narrow=("doc_id",))
    return out.select("doc_id", *[f.name for f in _FIELDS[:-1]], "base_failed", "kept", "log_perplexity")
