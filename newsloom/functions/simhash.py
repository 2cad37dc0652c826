"""64-bit SimHash over FNV-1a, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import simhash_tokens, trimmed

_START, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


def fnv1a64(tokens: list[bytes]) -> np.ndarray:
    """FNV-1a of some tokens, all of them byte by byte in step."""
    sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
    data = np.frombuffer(b"".join(tokens), np.uint8)
    starts, out = np.cumsum(sizes) - sizes, np.full(len(tokens), _START)
    for k in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > k)
        out[live] = (out[live] ^ data[starts[live] + k]) * _PRIME
    return out


@F.pandas_udf(T.LongType())
def _simhash(tokens: pd.Series) -> pd.Series:
    lists = [[] if x is None else list(x) for x in tokens]
    known = {t: i for i, t in enumerate(dict.fromkeys(t for x in lists for t in x))}
    bits = np.unpackbits(fnv1a64([t.encode() for t in known]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
    out = np.zeros(len(lists), np.int64)
    for i, own in enumerate(lists):
        if own:
            votes = bits[[known[t] for t in own]].sum(0, dtype=np.int64)
            out[i] = np.packbits(votes > 0, bitorder="little").view(np.int64)[0]
    return pd.Series(out)


#: Taken as not deterministic, so that a filter on a hash doesn't make Spark compute it twice.
_simhash = _simhash.asNondeterministic()


def simhash64(text: Column) -> Column:
    """Bit i is set if more token hashes have it than not; no token: 0. The bit pattern of an unsigned number, as a long."""
    return _simhash(simhash_tokens(text))


def article_simhash(title: Column, body: Column) -> Column:
    return simhash64(F.concat(trimmed(title), F.lit(" "), F.substring(body, 1, 400)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
