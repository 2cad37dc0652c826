"""Token counts of documents by a compiled finite-state tokenizer."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.common import table, with_arrow_columns
from newsloom.llm.transducer import transducer


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, column: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``over_limit`` (more than ``limit``), as the tokenizer of the file at ``path`` counts.

    Strings of special tokens inside a text count as one token; none is added. Null and empty texts: 0.
    The texts of a batch are one stream, whose chunks are read side by side and composed; a text of any length is
    part of it. Columns of the same names are replaced; an empty table gives an empty result.
    """

    def make():
        own = transducer(path)

        def compute(batch: pa.RecordBatch) -> list:
            counts = np.zeros(batch.num_rows, np.int64)
            for first, ends, outputs in own.read(t.as_py() for t in batch.column(column)):
                total = np.concatenate([[0], np.cumsum(own.counts(outputs))])
                counts[first : first + len(ends)] += np.diff(total[ends], prepend=0)
            return [counts, counts > limit]

        return compute

    return with_arrow_columns(docs, [T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())], make, holds=True)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
