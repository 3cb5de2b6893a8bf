"""Fusion and list operators on ranked results.

Lists are DataFrames with ``position`` (from 1) and optionally ``qid``; each fusion is one union
and one aggregation by identity, which combines in the map stage.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The constant of reciprocal rank fusion.
K = 60


def _stacked(lists: list[DataFrame]) -> DataFrame:
    if not lists:
        raise ValueError("nothing to fuse")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("list", F.lit(n)) for n, df in enumerate(lists)])


def _fused(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of ``part`` by identity; the other columns are those of the first list's row."""
    rest = [c for c in df.columns if c not in (*keys, "part", "list", "position")]
    first = F.min_by(F.struct(*rest), F.struct("list", "position")).alias("first") if rest else F.lit(None).alias("first")
    out = df.groupBy(*keys).agg(F.sum("part").alias("score"), first)
    return out.select(*keys, *(F.col(f"first.{c}").alias(c) for c in rest), "score")


def reciprocal_ranks(lists: list[DataFrame], key: str = "id", by: list[str] | None = None) -> DataFrame:
    """Sum of 1 / (60 + rank) over lists; the first list's row is kept."""
    keys = [*(by or []), key]
    return _fused(_stacked([df.drop("score") for df in lists]).withColumn("part", 1 / (F.lit(K) + F.col("position"))), keys)


def weighted_ranks(lists: dict[str, tuple[DataFrame, float]], identity: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Sum of weight * length / (60 + rank from 0), over the number of lists / 60, as column ``score``.

    ``identity`` names the columns that make two rows the same.  No lists, or no identity, are a ValueError.
    """
    identity = identity or ["id"]
    if not lists:
        raise ValueError("no results to fuse")
    by = by or []
    sized = [df.drop("score").withColumn("length", F.count("*").over(Window.partitionBy(*(by or [F.lit(0)])))).withColumn("weight", F.lit(float(w))) for df, w in lists.values()]
    part = F.col("weight") * F.col("length") / (F.lit(K) + F.col("position") - 1) / (len(lists) / K)
    return _fused(_stacked(sized).withColumn("part", part).drop("length", "weight"), [*by, *identity])


def local_global_ranks(local: DataFrame, global_: DataFrame, local_weight: float = 1.0, global_weight: float = 1.0, key: str = "id") -> DataFrame:
    """Sum of weight / (60 + rank from 0) of a local and a global list; the first row is kept, its score replaced."""
    sides = [df.drop("score").withColumn("part", F.lit(float(w)) / (F.lit(K) + F.col("position") - 1)) for df, w in ((local, local_weight), (global_, global_weight))]
    return _fused(_stacked(sides), [key])


def concatenated(lists: list[DataFrame]) -> DataFrame:
    """Lists one after the other, with ``list`` and ``position`` keeping their order."""
    return _stacked(lists)


def first_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: an aggregation with map-side combine, not a sort of whole groups."""
    if not keys:
        raise ValueError("no keys to deduplicate by")
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first")).select(*keys, *(F.col(f"first.{c}").alias(c) for c in rest)).select(*df.columns)


def ranked(df: DataFrame, order: list, by: list[str] | None = None, name: str = "position") -> DataFrame:
    """Position from 1 in each list."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*order)))
