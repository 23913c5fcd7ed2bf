"""Vector expressions: products, norms, the cosine variants, and an embedder that needs no model."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_search(a: Column, b: Column) -> Column:
    """Cosine with 1e-9 added to the product of norms, as ranking uses it."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-9))


def cosine_guarded(a: Column, b: Column) -> Column:
    """Cosine; 0 if a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def cosine_plain(a: Column, b: Column) -> Column:
    """Cosine without a guard: null for zero vectors."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def hashing_embedder(dim: int = 64, most: int | None = None):
    """A deterministic embedder: hashed words of the text (of its first `most` characters, where given), signed and scaled to length 1.

    It stands in for a model; any pandas UDF from string to array<float> fits in its place.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for w in (text or "")[:most].lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.sqrt((v * v).sum())
            out.append((v / n if n else v).astype(np.float32))
        return pd.Series(out, dtype=object)

    return embed


def key_hash(personal: str):
    """BLAKE2b of 8 bytes with a personalisation, little-endian, as a signed 64-bit key; Spark has no such built-in."""

    @F.pandas_udf(T.LongType())
    def hashed(texts: pd.Series) -> pd.Series:
        digest = lambda t: int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8, person=personal.encode()[:16]).digest(), "little", signed=True)
        return texts.map(digest, na_action="ignore").astype("Int64")

    return hashed
