"""Vector functions and the seam to embedding models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .text import let

BUCKETS = 32


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if one is null or zero, or their lengths differ. Either is computed once."""
    return let(a, lambda x: let(b, lambda y: F.when(F.size(x) == F.size(y), F.try_divide(dot(x, y), norm(x) * norm(y)))))


def hash_embed(text: Column) -> Column:
    """The offline embedder: lower-case tokens, hashed as h * 31 + code modulo 2**32 into 32 buckets, counts scaled to length 1.

    Modulo 32 a factor of 31 is one of -1, so a token's bucket takes only a difference a character; a bucket's count is by how much
    shorter the list of buckets is without it.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), 0)

    def bucket(t: Column) -> Column:
        return F.aggregate(F.split(t, ""), F.lit(0), lambda h, c: (F.ascii(c) - h).bitwiseAND(BUCKETS - 1))

    def counted(found: Column) -> Column:
        return F.array(*[(F.size(found) - F.size(F.array_remove(found, F.lit(i)))).cast("double") for i in range(BUCKETS)])

    counts = let(F.transform(tokens, bucket), lambda found: F.when(found.isNotNull(), counted(found)))
    return let(counts, lambda c: let(norm(c), lambda n: F.when(n > 0, F.transform(c, lambda x: x / n)).otherwise(c)))


Embedder = Callable[[list[str]], list[list[float]]]


def embed_with(df: DataFrame, text: str, provider: Embedder, *, batch: int = 32, column: str = "embedding") -> DataFrame:
    """``df`` with a model's embeddings of a text column: ``batch`` non-blank texts a call, in order; the shape of each answer is
    checked. Blank and null texts get null."""

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in frames:
            good = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            out: list = [None] * len(texts)
            for k in range(0, len(good), batch):
                part = good[k : k + batch]
                got = provider([texts.iloc[i] for i in part])
                if len(got) != len(part) or any(len(v) == 0 or not np.all(np.isfinite(v)) for v in got):
                    raise ValueError("the embedding provider must give one vector of finite numbers for each text")
                for i, v in zip(part, got, strict=True):
                    out[i] = [float(x) for x in v]
            yield pd.Series(out)

    return df.withColumn(column, F.pandas_udf(run, "array<double>")(F.col(text)))
