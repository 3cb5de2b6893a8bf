"""Search by vector and by words.

A single query is a constant in the plan: one scan, a partial top-k in every task, one merge.  A set of
queries is stated against all rows in blocks: rows stream past the queries in Arrow batches
and every task keeps the best of each query, so the exchange carries k rows a query and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.functions import vector as V
from sagebrook.functions.text import terms

#: Largest set of queries that is held in every task; larger sets go in several passes.
MOST_QUERIES = 20_000


def normalised(df: DataFrame) -> DataFrame:
    """Results with an empty map for missing metadata."""
    return df.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>"))) if "metadata" in df.columns else df


def semantic(chunks: DataFrame, query: list[float], limit: int = 10, where: Column | None = None, score: str = "clamped", min_similarity: float | None = None, key: str = "id", vector: str = "embedding", wide: bool = False, copies: bool = False) -> DataFrame:
    """The nearest rows by Euclidean distance with ``distance`` and ``score``; ties by key.

    ``wide`` computes distances with NumPy in Arrow batches, which pays for several hundred dimensions; else they are
    built-in expressions.  ``copies`` says that rows may share a key as copies of one record: they count once, and only after
    their vectors have shrunk to distances, so that no vector is exchanged.

    ``where`` filters before the top-k.  ``score`` is ``clamped`` (max(0, 1 - d)) or ``decaying`` (1 / (1 + d)).
    Rows whose vector is null or of another size are left out.
    """
    df = chunks if where is None else chunks.where(where)
    distance = V.l2_to(query)(F.col(vector)) if wide else V.l2(F.col(vector), V.literal(query))
    df = df.withColumn("distance", distance).where("distance IS NOT NULL AND NOT isnan(distance)")
    df = df.withColumn("score", V.clamped_score(F.col("distance")) if score == "clamped" else V.decaying_score(F.col("distance")))
    if min_similarity is not None:
        df = df.where(F.col("score") >= min_similarity)
    df = df.drop(vector)
    return normalised(df.dropDuplicates([key]) if copies else df).orderBy("distance", key).limit(limit)


def semantic_batch(chunks: DataFrame, queries: DataFrame, limit: int = 10, key: str = "id", vector: str = "embedding", qid: str = "qid") -> DataFrame:
    """(qid, id, distance, rank): the nearest rows of every query of a stated set; distances equal at 9 decimals by key.

    The queries are collected up to ``MOST_QUERIES`` at a time, a stated bound; each part is one pass over the rows
    without an exchange of them.  Null and unequal vectors on either side match nothing.
    """
    rows = queries.select(F.col(qid).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL")
    total = rows.count()
    numbered = rows.withColumn("part", F.pmod(F.xxhash64("q"), F.lit(max(1, -(-total // (MOST_QUERIES // 2))))))
    parts = []
    for (part,) in numbered.select("part").distinct().orderBy("part").collect():
        held = numbered.where(F.col("part") == part).limit(MOST_QUERIES + 1).collect()
        if len(held) > MOST_QUERIES:
            raise ValueError("too many queries with equal ids")
        sizes = {len(r.v) for r in held}
        for size in sorted(sizes):
            mine = [r for r in held if len(r.v) == size]
            parts.append(_pass(chunks, np.array([r.q for r in mine]), np.array([r.v for r in mine], float), limit, key, vector))
    if not parts:
        return chunks.sparkSession.createDataFrame([], "qid long, id long, distance double, rank int")
    best = Window.partitionBy("qid").orderBy(F.round("distance", 9), "id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def _pass(chunks: DataFrame, ids: np.ndarray, queries: np.ndarray, limit: int, key: str, vector: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, keys, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        bound = np.full(len(ids), np.inf)
        norm = (queries**2).sum(axis=1)[:, None]
        for batch in batches:
            lengths = np.asarray(batch.column(1).value_lengths().fill_null(-1))
            at = np.nonzero(lengths == queries.shape[1])[0]
            step = max(64, (2 << 20) // max(1, len(ids)))  # so that a block of similarities takes 16 MB
            for a in range(0, len(at), step):
                part = pa.array(at[a : a + step])
                x = np.asarray(batch.column(1).take(part).flatten().fill_null(float("nan")), float).reshape(-1, queries.shape[1])
                k = np.asarray(batch.column(0).take(part))
                good = np.isfinite(x).all(axis=1)
                x, k = x[good], k[good]
                if not len(k):
                    continue
                square = (x**2).sum(axis=1)[None, :]
                near = norm + square - 2 * queries @ x.T
                if len(k) > limit:
                    last = np.minimum(bound, np.sqrt(np.maximum(0, np.partition(near, limit - 1, axis=1)[:, limit - 1])))
                else:
                    last = bound
                # All within the rounding of the last, however many, so that the expanded form decides nothing.
                slack = 1e-11 * (norm[:, 0] + square.max())
                i, j = np.nonzero(near <= ((last + 2e-9) ** 2 + slack)[:, None])
                for c in range(0, len(i), 200_000):
                    m, n = i[c : c + 200_000], j[c : c + 200_000]
                    exact = np.sqrt(((queries[m] - x[n]) ** 2).sum(axis=1))
                    q, keys, best = np.append(q, m), np.append(keys, k[n]), np.append(best, exact)
                    order = np.lexsort((keys, np.round(best, 9), q))
                    q, keys, best = q[order], keys[order], best[order]
                    kept = np.arange(len(q)) - np.searchsorted(q, q) < limit
                    q, keys, best = q[kept], keys[kept], best[kept]
                full, first = np.unique(q, return_index=True)
                counts = np.diff(np.append(first, len(q)))
                bound[full[counts == limit]] = best[(first + limit - 1)[counts == limit]]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(keys), pa.array(best)], names=["qid", "id", "distance"])

    return chunks.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "qid long, id long, distance double")


def text_matches(chunks: DataFrame, query: str, text: str = "content", stop: bool = False, stem: bool = False, any_term: bool = False, copies_of: str | None = None) -> DataFrame:
    """Rows that hold all terms of the query (any of them with ``any_term``), with ``rank``.

    ``rank`` is the share of the text's terms that are terms of the query.  A query without terms matches nothing;
    operators in it are text.  Copies of a record, rows that share the key ``copies_of``, count once; only matches are exchanged.
    """
    wanted = F.array_distinct(terms(F.lit(query), stop, stem))
    found = terms(F.col(text), stop, stem)
    hit = F.size(F.filter(found, lambda x: F.array_contains(wanted, x)))
    match = F.arrays_overlap(found, wanted) if any_term else F.size(F.array_except(wanted, found)) == 0
    out = chunks.where((F.size(wanted) > 0) & match).withColumn("rank", hit / F.size(found))
    return out if copies_of is None else out.dropDuplicates([copies_of])


def fulltext(chunks: DataFrame, query: str, limit: int = 10, key: str = "id", text: str = "content", **options) -> DataFrame:
    """The best matches of all terms; ``score`` is their rank, ties by key."""
    return normalised(text_matches(chunks, query, text, **options).withColumn("score", F.col("rank"))).orderBy(F.desc("rank"), key).limit(limit)


def bm25(index: DataFrame, stats: tuple[int, float], query: str, limit: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the best documents of an inverted index by Okapi BM25."""
    n, mean = stats
    wanted = F.array_distinct(terms(F.lit(query)))
    hits = index.where(F.array_contains(wanted, F.col("term")))
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # as many rows as the query has terms
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(max(mean, 1e-9))))
    scored = hits.join(df, "term").withColumn("part", idf * part).groupBy("id").agg(F.sum("part").alias("score"))
    return scored.orderBy(F.desc("score"), "id").limit(limit)


def inverted_index(chunks: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(term, id, tf, length): an inverted index, to be written sorted or partitioned by term."""
    found = chunks.select(F.col(key).alias("id"), terms(F.col(text)).alias("t")).withColumn("length", F.size("t"))
    return found.select("id", "length", F.explode("t").alias("term")).groupBy("term", "id", "length").agg(F.count("*").alias("tf")).select("term", "id", "tf", "length")


def index_stats(chunks: DataFrame, text: str = "content") -> tuple[int, float]:
    """(documents with terms, mean number of terms), from the texts, without an exchange of them."""
    n, mean = chunks.select(F.size(terms(F.col(text))).alias("length")).where("length > 0").agg(F.count("*"), F.avg("length")).first()
    return n, mean or 0.0


def hybrid(chunks: DataFrame, vector: list[float], text: str, limit: int = 10, key: str = "id", copies: bool = False) -> DataFrame:
    """Vector and word search over one table, fused by reciprocal ranks; ``copies`` as for :func:`semantic`."""
    from sagebrook.operators.fusion import reciprocal_ranks

    columns = [c for c in ("content", "source", "metadata") if c in chunks.columns]
    base = chunks.select(key, *columns, "embedding")
    near = semantic(base, vector, limit, key=key, copies=copies).select(key, *columns, F.row_number().over(Window.orderBy("distance", key)).alias("position"))
    match = fulltext(base.drop("embedding"), text, limit, key=key, copies_of=key if copies else None).select(key, *columns, F.row_number().over(Window.orderBy(F.desc("rank"), key)).alias("position"))
    return reciprocal_ranks([near, match], key).orderBy(F.desc("score"), key).limit(limit)
