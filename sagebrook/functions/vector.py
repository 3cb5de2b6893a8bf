"""Distances and scores of vector columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def literal(vector: list[float]) -> Column:
    """A query vector as a constant column."""
    return F.array(*(F.lit(float(x)) for x in vector))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; null if either is null or their sizes differ."""
    total = F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(total))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either has length 0, null if sizes differ."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length))


def clamped_score(distance: Column) -> Column:
    """1 - distance, not below 0."""
    return F.greatest(F.lit(0.0), 1 - distance)


def decaying_score(distance: Column) -> Column:
    """1 / (1 + distance)."""
    return 1 / (1 + distance)


def l2_to(vector: list[float]):
    """Distance to a constant vector as an Arrow function, for wide vectors: NumPy over a whole batch."""
    q = np.asarray(vector, float)

    @F.pandas_udf("double")
    def distance(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = np.full(len(s), np.nan)
            at = [n for n, v in enumerate(s) if v is not None and len(v) == len(q)]
            if at:
                x = np.stack([s.iloc[n] for n in at]).astype(float)
                out[at] = np.sqrt(((x - q) ** 2).sum(axis=1))
            yield pd.Series(out)

    return lambda column: F.nanvl(distance(column), F.lit(None).cast("double"))
