"""Embeddings as fixed-width binary columns, and blocks of them in NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.storage import semi_join, written

#: Numbers of a usable embedding.
DIM = 64


def rows_of(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """Usable rows of a list column: (positions, float32 matrix).

    Usable means ``dim`` numbers, all finite, not all zero; nulls, nulls inside and other lengths are not.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.nonzero(lengths == dim)[0]
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64(), safe=False)
    wide = np.asarray(flat.fill_null(float("nan")), np.float64).reshape(-1, dim)
    good = np.isfinite(wide).all(axis=1) & (wide != 0).any(axis=1)
    return at[good], wide[good].astype(np.float32)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; scaled first, so that tiny and huge numbers keep their direction."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def binary(x: np.ndarray, kind: type = np.float32) -> pa.Array:
    """Rows of a matrix as binaries of numbers of a kind."""
    x = np.ascontiguousarray(x, kind)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])


def matrix(column: pa.Array, dim: int = DIM, kind: type = np.float32) -> np.ndarray:
    """Matrix of binaries without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.empty((0, dim), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, dim)


def rotations(count: int, dims: int, dim: int = DIM, seed: int = 29) -> np.ndarray:
    """``count`` random sets of ``dims`` orthonormal directions (count x dim x dims), the same for the same seed."""
    out = []
    for n in range(count):
        q, _ = np.linalg.qr(np.random.default_rng(seed + n).standard_normal((dim, dim)))
        out.append(q[:, :dims])
    return np.stack(out)


def tagged(tables: dict[str, DataFrame], key: str = "id", vector: str = "embedding") -> DataFrame:
    """(tab, id, embedding) of several tables; null keys are left out."""
    parts = [df.select(F.lit(name).alias("tab"), F.col(key).cast("long").alias("id"), F.col(vector).alias("embedding")).where("id IS NOT NULL") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def smallest_ids(df: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` smallest ids of each group with their rank ``r``, in two steps: no task sees a whole group."""
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    first = df.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy(*by, "part").orderBy("id"))).where(F.col("r") <= n)
    return first.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("r") <= n).drop("part")


def surplus_copies(rows: DataFrame, keep: int, least: int) -> tuple[DataFrame, DataFrame] | None:
    """Records whose embedding equals that of ``keep`` records with smaller ids, for embeddings that more than ``least`` rows share.

    ``rows(t, id, embedding)``.  Returns ``surplus(t, id, h)`` and ``kept(t, h, id, r)`` with the usable embeddings, or None
    if no embedding is shared by so many.
    """
    hashed = rows.select("t", "id", F.xxhash64("embedding").alias("h"))
    crowd = written(hashed.groupBy("t", "h").agg(F.count("*").alias("n")).where(F.col("n") > least).select("t", "h"), "crowd")
    if not crowd.limit(1).count():
        return None
    many = written(semi_join(hashed, crowd, ["t", "h"]).distinct(), "many")
    few = written(smallest_ids(many, ["t", "h"], keep), "few")
    first = few.where("r = 1").select("t", "id", "h")
    usable = semi_join(rows, first, ["t", "id"]).mapInArrow(_usable, "t byte, id long").distinct().join(first, ["t", "id"]).select("t", "h")
    kept = written(few.join(usable, ["t", "h"], "left_semi"), "kept")
    surplus = many.join(few.select("t", "h", "id"), ["t", "h", "id"], "left_anti").join(usable, ["t", "h"], "left_semi")
    return written(surplus.select("t", "id", "h"), "surplus"), kept


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, _ = rows_of(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at))], names=["t", "id"])


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of consecutive equal values in the first ``keys`` columns of a sorted stream, as (key, rows)."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not len(batch):
            continue
        change = np.zeros(len(batch), bool)
        for k in range(keys):
            c = batch.column(k)
            if len(c) > 1:
                change[1:] |= np.asarray(c.slice(1).to_numpy(zero_copy_only=False) != c.slice(0, len(c) - 1).to_numpy(zero_copy_only=False))
        starts = [0, *np.nonzero(change)[0].tolist(), len(batch)]
        for a, b in zip(starts, starts[1:]):
            now = tuple(batch.column(k)[a].as_py() for k in range(keys))
            if key is not None and now != key:
                yield key, pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)
