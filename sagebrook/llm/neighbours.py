"""The most similar embeddings of every embedding, by shifted space-filling curves.

Method: embeddings are projected on a few random directions and ordered along a Hilbert curve; several
orderings, turned and shifted against each other, are range-partitioned in one exchange.  In every
ordering a row is compared with the rows of its window, exactly, in blocks; what the
orderings found is merged and ranked anew.  Rows in crowds, where a window can't hold all that is similar, are
compared with all rows that may be similar enough, by distances to pivots, in salted pairs of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.llm.vectors import binary, matrix, rotations, rows_of, runs, surplus_copies, tagged, unit
from sagebrook.storage import semi_join, spread, written

#: Orderings, directions of a curve, bits a direction.
ORDERINGS, DIRECTIONS, BITS = 5, 6, 8
#: Rows compared at once, and how far a window reaches to either side, in rows.
BLOCK, REACH = 256, 1024
#: Span of the projections that the curve covers; what lies outside is put at its edge.
SPAN = 0.55
#: A row is in a crowd if so many rows of one of its windows are at this similarity or more.
CROWDED, DENSE = REACH // 2, 0.7
#: Rows a side of a pair of blocks in a crowd, rows that pivots are chosen from at once, how often, and their least distance.
CROWD_BLOCK, SAMPLE, SAMPLES, APART = 32_768, 4096, 8, 1.0


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of rows of non-negative integers below ``2 ** bits`` (Skilling, 2004)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q, p = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for i in range(n):
            up = (x[i] & q) != 0
            swap = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, np.uint64(0))
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] & np.uint64(1 << b)) != 0, np.uint64((1 << b) - 1), np.uint64(0))
    x ^= turn
    out = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)


def curve_keys(x: np.ndarray, orderings: int = ORDERINGS) -> np.ndarray:
    """Keys of unit rows in every ordering (rows x orderings)."""
    turned = rotations(orderings, DIRECTIONS, x.shape[1], seed=61)
    shift = np.random.default_rng(5).uniform(-0.08, 0.08, (orderings, DIRECTIONS))
    out = np.empty((len(x), orderings), np.int64)
    for g in range(orderings):
        place = (x @ turned[g] + shift[g] + SPAN) / (2 * SPAN)
        out[:, g] = hilbert(np.clip(place * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)
    return out


#: Rows of one range of the orderings, whatever the session's settings, and the most ranges; a range's end cuts the windows there, in one of the
#: orderings.
RANGE_ROWS, MOST_RANGES = 16 * REACH, 8192


def _ordered(orderings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = rows_of(batch.column(2))
            tabs, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a in range(0, len(at), 2048):
                part, rows = at[a : a + 2048], raw[a : a + 2048]
                keys = curve_keys(unit(rows), orderings)
                columns = [pa.array(np.tile(np.arange(orderings, dtype=np.int8), len(part))), pa.array(np.repeat(tabs[part], orderings)), pa.array(keys.ravel()), pa.array(np.repeat(ids[part], orderings)), binary(np.repeat(rows, orderings, axis=0))]
                yield pa.RecordBatch.from_arrays(columns, names=["o", "t", "key", "id", "v"])

    return run


#: Similarities in single precision are off by less than this, the rounding to 6 decimals included.
MARGIN = 1e-5


def best_of(near: np.ndarray, x: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row of y, similarity) of the best ``k`` of each row, from similarities in single precision (-2: none).

    All within the margin of the ``k``-th best, however many, are ranked by their similarity in double precision, rounded
    to 6 decimals, the smaller id first on ties.
    """
    # The k-th of the maxima of k or more groups of columns is at most the k-th best.
    width = max(1, min(64, near.shape[1] // (4 * k)))
    whole = near.shape[1] // width * width
    tops = near[:, :whole].reshape(len(near), -1, width).max(axis=2)
    least = np.partition(tops, tops.shape[1] - k, axis=1)[:, -k] if tops.shape[1] >= k else np.full(len(near), -2.0)
    least = np.maximum(least - MARGIN, max(floor - MARGIN, -1.5)).astype(np.float32)
    out: list[tuple[np.ndarray, ...]] = []
    i, j = np.nonzero(near >= least[:, None])
    if len(i) > near.size // 16 and near.shape[1] > k:
        by_id = np.argsort(ids, kind="stable")
        sim = np.where(near[:, by_id] < -1.5, -2, np.round(x @ y[by_id].T, 6))
        last = np.partition(sim, sim.shape[1] - k, axis=1)[:, -k, None]
        above, tie = sim > last, sim == last
        i, j = np.nonzero((above | (tie & (tie.cumsum(axis=1) <= k - above.sum(axis=1, keepdims=True)))) & (sim >= max(floor, -1.5)))
        sim = sim[i, j]
        order = np.lexsort((j, -sim, i))
        return i[order], by_id[j[order]], sim[order]
    for a, b in _slices(i, 200_000):
        m, n = i[a:b], j[a:b]
        sim = np.round((x[m] * y[n]).sum(axis=1), 6)
        keep = sim >= floor
        m, n, sim = m[keep], n[keep], sim[keep]
        order = np.lexsort((ids[n], -sim, m))
        m, n, sim = m[order], n[order], sim[order]
        keep = np.arange(len(m)) - np.searchsorted(m, m) < k
        out.append((m[keep], n[keep], sim[keep]))
    return _joined(out)


def _slices(rows: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ends of slices of about ``most`` entries of a sorted array that part no run of equal ones."""
    a = 0
    while a < len(rows):
        b = min(len(rows), a + most)
        b = int(np.searchsorted(rows, rows[b - 1], "right"))
        yield a, b
        a = b


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return tuple(np.concatenate(c) for c in zip(*parts))


def window_neighbours(ids: np.ndarray, x: np.ndarray, k: int, floor: float, reach: int = REACH, dense: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, similarity) of the best ``k`` of each row's window of ``reach`` rows to either side.

    ``dense`` is filled with the number of rows of the window that are at ``DENSE`` or more.
    """
    single = x.astype(np.float32)
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(x), BLOCK):
        low, high = max(0, a - reach), min(len(x), a + BLOCK + reach)
        near = single[a : a + BLOCK] @ single[low:high].T
        own = np.arange(len(near))
        near[own, own + a - low] = -2
        if dense is not None:
            dense[a : a + BLOCK] = np.count_nonzero(near >= DENSE, axis=1)
        i, j, sim = best_of(near, x[a : a + BLOCK], x[low:high], ids[low:high], k, floor)
        out.append((i + a, j + low, sim))
    return _joined(out)


def _windows(k: int, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, t), rows in runs(batches, 2):
            ids = np.asarray(rows.column("id"))
            x = unit(matrix(rows.column("v")))
            fresh = np.ones(len(ids), bool)  # copies of a record lie side by side
            fresh[1:] = ids[1:] != ids[:-1]
            ids, x = ids[fresh], x[fresh]
            dense = np.zeros(len(ids), np.int32)
            i, j, sim = window_neighbours(ids, x, k, floor, dense=dense)
            crowd = dense >= CROWDED
            who, near = _lists(i, ids[j], sim, len(ids), crowd)
            for a in range(0, len(who), 20_000):
                w = who[a : a + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), t, np.int8)), pa.array(ids[w]), pa.array(crowd[w]), near.slice(a, len(w))], names=["t", "id", "crowd", "near"])

    return run


def _lists(i: np.ndarray, other: np.ndarray, sim: np.ndarray, n: int, also: np.ndarray | bool = False) -> tuple[np.ndarray, pa.ListArray]:
    """Rows out of ``n`` that have entries, or are in ``also``, and the lists of their entries; ``i`` is sorted."""
    counts = np.bincount(i, minlength=n)
    who = np.nonzero((counts > 0) | also)[0]
    pairs = pa.StructArray.from_arrays([pa.array(-sim), pa.array(other)], names=["away", "other"])
    return who, pa.ListArray.from_arrays(pa.array(np.append(0, counts[who].cumsum()).astype(np.int32)), pairs)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * x @ pivots.T))


def _by_table(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(t, ids, float32 rows) of usable embeddings, a few thousand at a time."""
    for batch in batches:
        at, raw = rows_of(batch.column(2))
        tabs, ids = np.asarray(batch.column(0))[at], np.asarray(batch.column(1))[at]
        for t in np.unique(tabs):
            own = np.nonzero(tabs == t)[0]
            for a in range(0, len(own), 2048):
                yield int(t), ids[own[a : a + 2048]], raw[own[a : a + 2048]]


def _homes(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ids, raw in _by_table(batches):
            d = _distances(unit(raw), pivots[t]) if t in pivots else np.full((len(ids), 1), 2.0)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), t, np.int8)), pa.array(ids), pa.array(d.argmin(axis=1).astype(np.int32)), pa.array(d.min(axis=1)), binary(raw)], names=["t", "id", "home", "d", "v"])

    return run


def _pivots_of(members: DataFrame) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Pivots of crowds by table, and the largest distance of a member whose nearest pivot it is."""
    pivots: dict[int, np.ndarray] = {}
    for _ in range(SAMPLES):
        far = members.mapInArrow(_homes(pivots), "t byte, id long, home int, d double, v binary").where(F.col("d") > APART)
        sample = far.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("t", "v").collect()
        if not sample:
            break
        for t in {r.t for r in sample}:
            x = unit(np.stack([np.frombuffer(r.v, np.float32) for r in sample if r.t == t]))
            leaders = x[:1]
            nearest_one = _distances(x, leaders)[:, 0]
            while (nearest_one > APART).any():
                new = x[[int(np.argmax(nearest_one > APART))]]
                leaders = np.vstack([leaders, new])
                nearest_one = np.minimum(nearest_one, _distances(x, new)[:, 0])
            home = _distances(x, leaders).argmin(axis=1)
            means = unit(np.stack([x[home == n].sum(axis=0) for n in range(len(leaders))]))
            pivots[t] = np.vstack([pivots[t], means]) if t in pivots else means
    radius = {t: np.full(len(p), -9.0) for t, p in pivots.items()}
    reached = members.mapInArrow(_homes(pivots), "t byte, id long, home int, d double, v binary").groupBy("t", "home").agg(F.max("d").alias("d"))
    for r in reached.collect():
        radius[r.t][r.home] = r.d
    return pivots, radius


def _met(pivots: dict[int, np.ndarray], radius: dict[int, np.ndarray], floor: float, blocks: dict[int, np.ndarray] | None):
    """Every row near a crowd, once for each block of rows that it meets; without ``blocks`` the numbers of rows.

    A row asks (side 0) if it lies within the radius of a pivot, and is asked (side 1) at its own, nearest pivot.  Another row
    within ``r`` of a row that asks has a nearest pivot at most 2 ``r`` farther from it than its own: a bound that leaves out none.
    """
    r = math.sqrt(max(0.0, 2 - 2 * floor)) + 1e-3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ids, raw in _by_table(batches):
            if t not in pivots:
                continue
            d = _distances(unit(raw), pivots[t])
            asks = (d <= radius[t] + 1e-3).any(axis=1)
            i, q = np.nonzero(asks[:, None] & (d - d.min(axis=1, keepdims=True) <= 2 * r))
            j = np.nonzero((d <= radius[t] + r).any(axis=1))[0]
            home = d.argmin(axis=1)[j]
            if blocks is None:
                for side, where in ((0, q), (1, home)):
                    n = np.bincount(where)
                    at = np.nonzero(n)[0]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int8)), pa.array(at.astype(np.int32)), pa.array(np.full(len(at), side, np.int8)), pa.array(n[at])], names=["t", "q", "side", "n"])
                continue
            salt = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for side, row, where in ((0, i, q), (1, j, home)):
                own, times = blocks[t][where, side], blocks[t][where, 1 - side]
                copy = np.repeat(np.arange(len(row)), np.where(own > 0, times, 0))
                other = np.arange(len(copy)) - np.searchsorted(copy, copy)
                mine = salt[row[copy]] % own[copy]
                a, b = (mine, other) if side == 0 else (other, mine)
                columns = [np.full(len(copy), t, np.int8), where[copy].astype(np.int32), a.astype(np.int32), b.astype(np.int32), np.full(len(copy), side, np.int8), ids[row[copy]]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), binary(raw[row[copy]])], names=["t", "q", "a", "b", "side", "id", "v"])

    return run


def _crossed(k: int, floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, *_), rows in runs(batches, 4):
            side, ids = np.asarray(rows.column("side")), np.asarray(rows.column("id"))
            x = unit(matrix(rows.column("v")))
            (left, p), (right, q) = (np.unique(ids[side == s], return_index=True) for s in (0, 1))
            if not len(left) or not len(right):
                continue
            x, y = x[side == 0][p], x[side == 1][q]
            turned = y.astype(np.float32).T
            step = max(1, (4 << 20) // len(right))
            for a in range(0, len(left), step):
                near = x[a : a + step].astype(np.float32) @ turned
                at = np.minimum(np.searchsorted(right, left[a : a + step]), len(right) - 1)
                own = np.nonzero(right[at] == left[a : a + step])[0]
                near[own, at[own]] = -2
                i, j, sim = best_of(near, x[a : a + step], y, right, k, floor)
                who, lists = _lists(i, right[j], sim, len(near))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(who), t, np.int8)), pa.array(left[a + who]), lists], names=["t", "id", "near"])

    return run


def crowd_neighbours(rows: DataFrame, crowd: DataFrame, k: int, floor: float) -> DataFrame:
    """(t, id, near): the best ``k`` of the rows in and about crowds among all rows, in parts; ``crowd(t, id)`` are members.

    Exact: what a row isn't compared with is below ``floor`` by the triangle inequality.  Work grows with the square of a crowd.
    """
    pivots, radius = _pivots_of(spread(semi_join(rows, crowd, ["t", "id"])))
    counts = rows.mapInArrow(_met(pivots, radius, floor, None), "t byte, q int, side byte, n long").groupBy("t", "q", "side").agg(F.sum("n").alias("n"))
    blocks = {t: np.zeros((len(p), 2), np.int64) for t, p in pivots.items()}
    for r in counts.collect():
        blocks[r.t][r.q, r.side] = -(-r.n // CROWD_BLOCK)
    pairs = int(sum(b.prod(axis=1).sum() for b in blocks.values()))
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs)
    met = spread(rows).mapInArrow(_met(pivots, radius, floor, blocks), "t byte, q int, a int, b int, side byte, id long, v binary")
    placed = met.repartition(parts, "t", "q", "a", "b").sortWithinPartitions("t", "q", "a", "b")
    return placed.mapInArrow(_crossed(k, floor), "t byte, id long, near array<struct<away:double,other:long>>")


def nearest(tables: dict[str, DataFrame], k: int = 5, floor: float = -1.0, key: str = "id", vector: str = "embedding", orderings: int = ORDERINGS) -> DataFrame:
    """(tab, id, rank, neighbour, similarity): the up to ``k`` most similar records of the same table.

    Similarity is the cosine in double precision, rounded to 6 decimals; those below ``floor`` are left out, on equal
    similarity the smaller id comes first.  Every usable record is a query and is in the index; approximate is
    only which pairs meet in a window (recall against brute force: README); in crowds all meet.

    Rows that share an id are one record; unusable embeddings and null ids are left out; of equal embeddings only
    the ``k`` + 1 smallest ids take part in the windows, which is exact: the others' neighbours are the ``k``
    smallest.  Empty tables give no rows; extra columns are not read.
    """
    names = list(tables)
    number = F.create_map(*(x for n, t in enumerate(names) for x in (F.lit(t), F.lit(n).cast("byte"))))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("t") + 1)
    rows = tagged(tables, key, vector).select(number[F.col("tab")].alias("t"), "id", "embedding").where(F.size("embedding") > 0)
    copies = surplus_copies(rows, k + 1, k + 1)
    if copies is not None:
        surplus, kept = copies
        heads = kept.where(F.col("r") <= k).select("t", "h", F.col("id").alias("other"))
        same = surplus.join(heads, ["t", "h"]).select("t", "id", "other")
        rows = rows.join(surplus.select("t", "id"), ["t", "id"], "left_anti")
    n = sum(df.count() for df in tables.values()) * orderings
    parts = min(MOST_RANGES, max(1, n // RANGE_ROWS))
    placed = spread(rows).mapInArrow(_ordered(orderings), "o byte, t byte, key long, id long, v binary").repartitionByRange(parts, "o", "t", "key", "id").sortWithinPartitions("o", "t", "key", "id")
    found = placed.mapInArrow(_windows(k, floor), "t byte, id long, crowd boolean, near array<struct<away:double,other:long>>")
    # At most k candidates a record from each ordering and each block of a crowd.
    best = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near")
    merged = written(found.groupBy("t", "id").agg(best, F.max("crowd").alias("crowd")), "near")
    crowd = merged.where("crowd").select("t", "id")
    if crowd.limit(1).count():
        merged = merged.select("t", "id", "near").unionByName(crowd_neighbours(rows, crowd, k, floor)).groupBy("t", "id").agg(best)
    ranked = merged.select("t", "id", F.posexplode("near").alias("rank", "n")).select("t", "id", (F.col("rank") + 1).alias("rank"), F.col("n.other").alias("neighbour"), (-F.col("n.away")).alias("similarity"))
    if copies is not None:
        w = Window.partitionBy("t", "id").orderBy("other")
        rest = same.where(F.lit(1.0) >= floor).withColumn("rank", F.row_number().over(w)).select("t", "id", "rank", F.col("other").alias("neighbour"), F.lit(1.0).alias("similarity"))
        ranked = ranked.unionByName(rest)
    return ranked.select(name.alias("tab"), "id", "rank", "neighbour", "similarity")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(tab, id_a, id_b): pairs of which one is a neighbour of the other."""
    return found.select("tab", F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
