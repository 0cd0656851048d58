"""Vector expressions over array<float> columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _d(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Inner product."""
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit(a: Column) -> Column:
    """Scaled to length one; a zero vector stays."""
    n = norm(a)
    return F.transform(_d(a), lambda x: F.when(n > 0, x / n).otherwise(x))


def fault(a: Column, size: int) -> Column:
    """Why a vector can't be used: missing, dimension, not finite, zero; null where it can."""
    return (
        F.when(a.isNull(), "missing")
        .when(F.size(a) != size, "dimension")
        .when(F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite")
        .when(norm(a) == 0, "zero")
    )


def hashed_bag(tokens: Column, size: int) -> Column:
    """A vector of token counts in hashed places with hashed signs, scaled to length one: the default of tests.

    Null tokens give null; no tokens give the zero vector.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def bag(v: pd.Series) -> pd.Series:
        out = []
        for words in v:
            if words is None:
                out.append(None)
                continue
            h = np.array([xxhash.xxh64_intdigest(w) for w in words], dtype=np.uint64)
            x = np.bincount((h >> np.uint64(1)) % np.uint64(size), weights=1.0 - 2.0 * (h & np.uint64(1)), minlength=size) if len(h) else np.zeros(size)
            n = np.linalg.norm(x)
            out.append(x / n if n else x)
        return pd.Series(out)

    return bag(tokens)
