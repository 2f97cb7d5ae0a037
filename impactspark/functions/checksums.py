"""Checksums and hashes over the bytes of a column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, LongType


def fletcher(data: bytes) -> int:
    """Fletcher-16: two running sums modulo 255, the second one high."""
    if not data:
        return 0
    a = np.frombuffer(data, np.uint8).astype(np.int64)
    n = len(a)
    return int((a * (np.arange(n, 0, -1) % 255)).sum() % 255) << 8 | int(a.sum() % 255)


@pandas_udf(IntegerType())
def fletcher16(text: pd.Series) -> pd.Series:
    """fletcher() of a column, all its bytes at once."""
    data = [b"" if t is None else t.encode() if isinstance(t, str) else bytes(t) for t in text]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat, of = np.frombuffer(b"".join(data), np.uint8).astype(np.int64), np.repeat(np.arange(len(data)), sizes)
    left = (np.cumsum(sizes)[of] - np.arange(len(flat))) % 255
    low, high = (np.bincount(of, w, len(data)).astype(np.int64) % 255 for w in (flat, flat * left))
    return pd.Series(high << 8 | low).astype("Int32").mask(text.isna().to_numpy())


def permutation(seed: int = 1990) -> np.ndarray:
    """A fixed permutation of the bytes for Pearson's hash; any other may be given to pearson()."""
    return np.random.default_rng(seed).permutation(256).astype(np.uint8)


TABLE = permutation().tolist()


def pearson(data: bytes, width: int = 8, table: list[int] | None = None) -> int:
    """Pearson's hash of 8, 16, 24 or 32 bits: each further byte of it begins from another first byte."""
    t, out = TABLE if table is None else table, 0
    for turn in range(width // 8):
        h = t[((data[0] if data else 0) + turn) & 255]
        for c in data[1:]:
            h = t[h ^ c]
        out |= h << (8 * turn)
    return out


def pearson_hash(text: Column, width: int = 16, table: list[int] | None = None) -> Column:
    """pearson() of a column, long; values of one text are the same whatever the batch, so each is hashed once."""

    @pandas_udf(LongType())
    def run(texts: pd.Series) -> pd.Series:
        codes, values = pd.factorize(texts)
        found = np.array([pearson(v.encode() if isinstance(v, str) else bytes(v), width, table) for v in values] or [0], np.int64)
        return pd.Series(np.where(codes < 0, 0, found[np.maximum(codes, 0)])).mask(pd.Series(codes < 0))

    return run(text)


def pearson16(text: Column) -> Column:
    return pearson_hash(text, 16).cast("int")
