"""An inverted-list layout for vector search.

Centroids are fitted to a bounded sample; every row is assigned to its nearest centroid and the table is
written partitioned by it.  A search reads only the lists nearest to the query, by partition pruning; with
all lists it is exact.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebrook.operators.search import semantic

#: Rows of the sample that the centroids are fitted to.
SAMPLE = 20_000


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    at = np.nonzero(lengths == dim)[0]
    x = np.asarray(column.take(pa.array(at)).flatten().cast(pa.float64()).fill_null(float("nan"))).reshape(-1, dim)
    good = np.isfinite(x).all(axis=1)
    return at[good], x[good]


def fit_centroids(df: DataFrame, lists: int, vector: str = "embedding", sample: int = SAMPLE, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """k-means on at most ``sample`` rows, taken by a hash of the vector."""
    rows = df.select(vector).where(F.size(vector) > 0).orderBy(F.xxhash64(vector)).limit(sample).toArrow().column(0).combine_chunks()
    if not len(rows):
        raise ValueError("no vectors to fit centroids to")
    dim = int(np.bincount(np.asarray(rows.value_lengths())).argmax())
    x = _matrix(rows, dim)[1]
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, total / np.maximum(1, n), centres)
    return centres


def write_index(df: DataFrame, path: str, lists: int = 100, vector: str = "embedding", **options) -> np.ndarray:
    """Write ``df`` partitioned by ``list``; rows without a usable vector are in list -1.  Returns the centroids, which lie beside."""
    centres = fit_centroids(df, lists, vector, **options)
    place = df.schema.fieldNames().index(vector)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres**2).sum(axis=1)[None, :]
        for batch in batches:
            out = np.full(len(batch), -1, np.int32)
            at, x = _matrix(batch.column(place), centres.shape[1])
            if len(at):
                out[at] = (half - 2 * x @ centres.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "list"])

    placed = df.mapInArrow(assign, T.StructType([*df.schema.fields, T.StructField("list", T.IntegerType())]))
    # Large lists are spread over several files: the second key splits them.
    placed.repartition("list", F.pmod(F.xxhash64(vector), F.lit(8))).write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    spark = df.sparkSession
    spark.createDataFrame([(json.dumps(centres.tolist()),)], "centroids string").coalesce(1).write.mode("overwrite").json(f"{path}/centroids")
    return centres


def search_index(spark: SparkSession, path: str, query: list[float], limit: int = 10, probes: int = 10, **options) -> DataFrame:
    """The nearest rows among the ``probes`` lists whose centroids are nearest to the query."""
    centres = np.array(json.loads(spark.read.schema("centroids string").json(f"{path}/centroids").first()[0]))
    near = ((centres - np.asarray(query, float)) ** 2).sum(axis=1).argsort(kind="stable")[:probes]
    rows = spark.read.parquet(f"{path}/rows").where(F.col("list").isin([int(n) for n in near])).drop("list")
    return semantic(rows, query, limit, **options)
