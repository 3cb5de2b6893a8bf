"""Clusters of similar embeddings by grids of their projections.

Method: embeddings are projected on a few random directions and quantised; several grids, turned and
shifted against each other, are used at once.  Cells are counted in SQL.  Within a cell the members that are similar enough hang on its
smallest member; adjacent cells that hold rows are joined at the face they share: a row near a face visits the cell beyond it, if there is one, and is
compared with the rows that live there.  Cells share members across the grids as well, and the smallest label spreads
until nothing changes.  A cluster's typical members are those of its densest cell.

The grids only choose which pairs are compared; a link needs the similarity itself.  Where half precision
can't tell whether a pair reaches the threshold, it is computed anew in double precision.  How many
directions a grid has follows from the number of rows, so that a cell has about as many rows on any table; how
many grids there are, and how near a face rows visit, follows from the chance that a grid parts a pair just at the threshold and
no visit makes up for it.  Inside of its task a large cell is cut by finer grids of the same kind, several of them turned against each
other, so that a row is not compared with all rows of its cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.llm.vectors import DIM, binary, matrix, rotations, rows_of, runs, surplus_copies, tagged, unit
from sagebrook.operators.components import connected_components
from sagebrook.storage import dropped, semi_join, small_enough, spread, written

#: Width of a cell along a direction, and how far its edge may lie from the middle of unit vectors.
WIDTH, SHIFT = 0.5, 0.09
#: Wanted chance to compare a pair at the threshold; about so many rows a cell holds, whatever the table's size.
RECALL, CELL_ROWS = 0.985, 40_000.0
#: Rows of a block of a cell; cells above it are spread over tasks by pairs of blocks.
BLOCK = 131_072
#: Rows of a block that are compared without finer grids, and about how many a cell of a finer grid holds.
PLAIN_ROWS, FINE_ROWS = 2048, 192
#: How near a face of a finer grid rows visit (as in ``caught``), and the wanted chance that finer grids compare a pair that a cell holds.
FINE_NEAR, FINE_RECALL = 0.8, 0.99
#: At least so many pairs are held before they are merged into the labels.
HELD = 1 << 16
#: Rows that share one embedding above which all but one are linked to it directly and stay out of the grids.
COPIES = 32
#: Embeddings travel in half precision; a similarity computed from them is off by less than this.
DOUBT = 1.2e-3
#: Share of the rows that one direction leaves together, and density at an edge, for unit vectors without structure.
TOGETHER, DENSITY = 0.53, 2.9


def _deviation(threshold: float) -> float:
    """Standard deviation of the difference of a pair at the threshold along one direction."""
    return math.sqrt(2 * (1 - threshold) / DIM)


def caught(near: float) -> float:
    """Share of the pairs parted by one face of which a row visits, if rows nearer than ``near`` deviations do.

    Those at most twice as far apart, and of the others (the distance of parted pairs has the density
    r exp(-r^2 / 2)) the share 2 near / r that lie so.
    """
    return 1 - math.exp(-2 * near**2) + 2 * near * math.sqrt(math.pi / 2) * math.erfc(math.sqrt(2) * near)


def _meet(dims: int, parted: float, near: float) -> float:
    """Chance that one grid compares a pair that a direction parts with the chance ``parted``."""
    return (1 - parted) ** dims + caught(near) * dims * parted * (1 - parted) ** (dims - 1)


@cache
def _plan(dims: int, threshold: float) -> tuple[int, float]:
    """(grids, how near a face rows visit) that reach the recall with the fewest exchanged rows."""
    deviation = _deviation(threshold)
    parted = min(0.9, deviation * math.sqrt(2 / math.pi) * DENSITY)
    best = None
    for near in np.arange(0, 1.5, 0.02).tolist():
        grids = max(3, math.ceil(math.log(1 - RECALL) / math.log(1 - FINE_RECALL * _meet(dims, parted, near))))
        cost = grids * (1 + dims * 2 * near * deviation * DENSITY)
        if best is None or cost < best[0]:
            best = cost, grids, near
    return best[1:]


def grid_shape(rows: int, threshold: float) -> tuple[int, int]:
    """(directions, grids) for a number of rows."""
    dims = max(3, min(DIM, round(math.log(max(1.0, rows / CELL_ROWS)) / -math.log(TOGETHER))))
    return dims, _plan(dims, threshold)[0]


def _hashed(code: np.ndarray, tab: np.ndarray, grid: int) -> np.ndarray:
    """One number for the cell of each row in a grid."""
    key = (tab.astype(np.uint64) << np.uint64(40)) + np.uint64(grid)
    with np.errstate(over="ignore"):
        for d in range(code.shape[1]):
            key = (key ^ code[:, d].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(31)
        key *= np.uint64(0xBF58476D1CE4E5B9)
    return key.view(np.int64)


def _cells(x: np.ndarray, tab: np.ndarray, dims: int, grids: int, near: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, their cells, whether they visit): every row's own cell in every grid, and the cells beyond faces nearer than ``near``."""
    turned = rotations(grids, dims)
    shift = np.random.default_rng(7).uniform(-SHIFT, SHIFT, (grids, dims))
    every = np.arange(len(x))
    for g in range(grids):
        place = (x @ turned[g] + shift[g]) / WIDTH + 16
        code = np.floor(place).astype(np.int64)
        yield every, _hashed(code, tab, g), False
        for d in range(dims) if near > 0 else ():
            rest = place[:, d] - code[:, d]
            for step, at in ((-1, np.nonzero(rest * WIDTH < near)[0]), (1, np.nonzero((1 - rest) * WIDTH < near)[0])):
                beyond = code[at]
                beyond[:, d] += step
                yield at, _hashed(beyond, tab[at], g), True


def _keyed(dims: int, grids: int, near: float, with_vectors: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = rows_of(batch.column(2))
            tabs, ids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a in range(0, len(at), 2048):
                part, x = at[a : a + 2048], unit(raw[a : a + 2048])
                found = list(_cells(x, tabs[part], dims, grids, near))
                rows = np.concatenate([r for r, _, _ in found])
                columns = [pa.array(tabs[part][rows]), pa.array(ids[part][rows]), pa.array(np.concatenate([c for _, c, _ in found])), pa.array(np.concatenate([np.full(len(r), v) for r, _, v in found]))]
                if with_vectors:
                    columns.append(binary(x[rows], np.float16))
                yield pa.RecordBatch.from_arrays(columns, names=["t", "id", "cell", "visits", "v"][: len(columns)])

    return run


def _merge(low: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels after the components ``p`` and ``q`` of each pair become one."""
    apart = p != q
    if not apart.any():
        return low
    p, q = p[apart], q[apart]
    codes = np.sort(np.minimum(p, q) * len(low) + np.maximum(p, q))
    codes = codes[np.append(True, codes[1:] != codes[:-1])]
    p, q = codes // len(low), codes % len(low)
    root = np.arange(len(low))
    while True:
        new = root.copy()
        np.minimum.at(new, q, root[p])
        np.minimum.at(new, p, root[q])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root[low]
        root = new


def _crowd(z: np.ndarray, low: np.ndarray, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Labels after joining what a few leaders reach, and which rows lie outside of the largest component.

    Pairs within one component need no look: a crowd of similar rows costs a comparison with its leader and with the
    rows outside, not with itself.
    """
    some = np.unique(np.linspace(0, len(z) - 1, 64).astype(int))
    density = (z[some] @ z[some].T >= floor + DOUBT).sum(axis=1)
    for k in some[np.argsort(-density, kind="stable")[:6]]:
        hit = z @ z[k] >= floor + DOUBT
        low = _merge(low, low[hit], np.full(hit.sum(), low[k]))
    return low, low != np.bincount(low).argmax()


@cache
def _turned(table: int) -> np.ndarray:
    """Directions of a finer grid."""
    return rotations(1, 16, seed=1009 + table)[0].astype(np.float32)


def _fine_grid(z: np.ndarray, table: int, deviation: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """Cells (rows that live there, rows that visit) of a finer grid, and the chance that it compares a pair at the threshold.

    Faces lie at the medians, so that cells are about as large wherever the rows lie; the chance follows from how many
    rows lie near the faces.
    """
    n, near = len(z), FINE_NEAR * deviation
    dims = min(15, max(1, round(math.log2(n / FINE_ROWS))))
    place = z @ _turned(table)[:, :dims]
    place -= np.median(place, axis=0)
    code = (place > 0) @ (1 << np.arange(dims))
    at, d = np.nonzero(np.abs(place) < near)
    parted = min(0.9, deviation * math.sqrt(2 / math.pi) * len(at) / (n * dims * 2 * near))
    rows, cell = np.concatenate([np.arange(n), at]), np.concatenate([code, code[at] ^ (1 << d)]).astype(np.uint16)
    order = np.argsort(cell, kind="stable")  # those that live in a cell come first
    rows, edges = rows[order], np.arange(1 << dims)
    starts, ends = np.searchsorted(cell[order], edges), np.searchsorted(cell[order], edges, "right")
    lives = np.bincount(code, minlength=1 << dims)
    return [(rows[a : a + k], rows[a + k : b]) for a, k, b in zip(starts.tolist(), lives.tolist(), ends.tolist()) if k and b - a > 1], _meet(dims, parted, FINE_NEAR)


def _looks(home: np.ndarray, guests: np.ndarray, left: np.ndarray, outside: np.ndarray, inside: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Which rows to compare with which: those that live in a cell with all, the second block's with the first's only, no pair within the largest component."""
    ours, theirs = home[left[home]], home[~left[home]]
    near, far = guests[left[guests]], guests[~left[guests]]
    rest = np.concatenate([theirs, far, near] if inside else [theirs, far])
    looks = [
        (ours[outside[ours]], np.concatenate([ours, rest]) if inside else rest),
        (ours[~outside[ours]], rest[outside[rest]]),
        (theirs[outside[theirs]], near),
        (theirs[~outside[theirs]], near[outside[near]]),
    ]
    return [(rows, columns) for rows, columns in looks if len(rows) and len(columns)]


def _hang(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray, floor: float, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (a, b, sure) between the rows of two blocks, and with ``inside`` among those of the first.

    Sure links connect all that sure pairs connect: every row hangs on the smallest id it reaches.  Pairs in
    doubt are given as they are, unless sure links connect them.  Small blocks are compared in full, larger ones within
    the cells of finer grids, of which there are as many as the wanted chance needs; where rows lie so close
    that those would compare more than all pairs, all pairs are compared.
    """
    n = len(ids)
    all_ids, z = np.concatenate([ids, others]), np.concatenate([x, y]) if len(y) else x
    order = np.argsort(all_ids, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    low, outside = rank.copy(), np.ones(len(z), bool)
    if len(z) > 512:
        low, outside = _crowd(z, low, floor)
    at = np.arange(len(z))
    left = at < n
    doubt, held, waiting = [np.empty((2, 0), np.int64)], [np.empty((2, 0), np.int64)], 0

    def merged() -> None:
        nonlocal low, waiting
        i, j = np.concatenate(held, axis=1)
        low, held[:], waiting = _merge(low, low[i], low[j]), [np.empty((2, 0), np.int64)], 0
        pairs = np.concatenate(doubt, axis=1)
        doubt[:] = [pairs[:, low[pairs[0]] != low[pairs[1]]]]

    def compared(cells: list[tuple[np.ndarray, np.ndarray]]) -> None:
        nonlocal waiting
        for home, guests in cells:
            for rows, columns in _looks(home, guests, left, outside, inside):
                y = z[columns].T
                for a in range(0, len(rows), 1024):
                    part = rows[a : a + 1024]
                    near = z[part] @ y
                    hits = np.flatnonzero(near >= floor - DOUBT)
                    i, j = part[hits // len(columns)], columns[hits % len(columns)]
                    new = low[i] != low[j]
                    if new.any():
                        pairs, sure = np.stack([i, j])[:, new], near.ravel()[hits[new]] >= floor + DOUBT
                        held.append(pairs[:, sure])
                        doubt.append(pairs[:, ~sure])
                        waiting += len(sure)
                        if waiting > max(HELD, len(z)):
                            merged()

    miss, table = 1.0, 0
    while miss > 1 - FINE_RECALL:
        cells, meet = [(at, at[:0])], 1.0
        if len(z) > PLAIN_ROWS:
            fine, chance = _fine_grid(z, table, _deviation(floor))
            tables = max(1.0, math.log((1 - FINE_RECALL) / miss) / math.log(1 - chance))
            if tables * sum(len(home) * (len(home) + len(guests)) for home, guests in fine) < len(z) * n:
                cells, meet = fine, chance
        compared(cells)
        merged()
        miss, table = miss * (1 - meet), table + 1
    i, j = np.concatenate(doubt, axis=1)
    apart = low[i] != low[j]
    moved = low != rank
    a = np.concatenate([all_ids[moved], all_ids[i[apart]]])
    b = np.concatenate([all_ids[order[low[moved]]], all_ids[j[apart]]])
    return a, b, np.arange(len(a)) < moved.sum()


def _linked(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (t, _, pair), rows in runs(batches, 3):
            left = np.asarray(rows.column("side")) == 0
            ids = np.asarray(rows.column("id"))
            x = matrix(rows.column("v"), kind=np.float16).astype(np.float32)
            (own, p), (other, q) = (np.unique(ids[at], return_index=True) for at in (left, ~left))
            inside = pair < 0 or not len(other)
            if not len(own) or not inside and not len(other) or len(own) + len(other) < 2:
                continue
            a, b, sure = _hang(own, x[left][p], other, x[~left][q], floor, inside)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), t, np.int8)), pa.array(a), pa.array(b), pa.array(sure)], names=["t", "a", "b", "sure"])

    return run


def _raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, raw = rows_of(batch.column(2))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), binary(raw)], names=["t", "id", "v"])


def _exact(floor: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = (unit(matrix(batch.column(3))) * unit(matrix(batch.column(4)))).sum(axis=1) if len(batch) else np.empty(0)
            yield pa.RecordBatch.from_arrays(batch.columns[:3], names=["t", "a", "b"]).filter(pa.array(np.round(cosine, 6) >= floor))

    return run


def similar_components(tables: dict[str, DataFrame], threshold: float = 0.9, key: str = "id", vector: str = "embedding", block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Chains of similar embeddings within each table.

    Returns ``labels(tab, id, cluster_id)``, every record that is linked to another, with the smallest id of its
    cluster, and ``cells(tab, id, cell)``, its cell in the first grid.  Similarity is the cosine in double
    precision, rounded to 6 decimals.

    Rows that share an id are one record; unusable embeddings (null, wrong length, not finite, all zero) and null ids are
    left out; equal embeddings have similarity 1, and many of them
    cost as much as one; empty tables give no rows; extra columns are not read.  A
    cell of more than ``block`` rows, such as one third of all rows, is cut into blocks by id, and each
    pair of blocks is a task of its own: nothing is dropped.
    """
    names = list(tables)
    number = F.create_map(*(x for n, t in enumerate(names) for x in (F.lit(t), F.lit(n).cast("byte"))))
    name = F.element_at(F.array(*map(F.lit, names)), F.col("t") + 1)
    rows = tagged(tables, key, vector).select(number[F.col("tab")].alias("t"), "id", "embedding")
    every, copies = rows, surplus_copies(rows, 1, COPIES)
    if copies is not None:
        rows = rows.join(copies[0].select("t", "id"), ["t", "id"], "left_anti")
    most = max((df.count() for df in tables.values()), default=0)
    dims, grids = grid_shape(most, threshold)
    near = _plan(dims, threshold)[1] * _deviation(threshold)
    keyed = rows.mapInArrow(_keyed(dims, grids, near, False), "t byte, id long, cell long, visits boolean")
    counts = keyed.groupBy("cell").agg(F.count_if(~F.col("visits")).alias("n"), F.count_if("visits").alias("m"))
    counts = written(counts.where("n > 0 AND n + m > 1"), "cells")
    full = spread(rows).mapInArrow(_keyed(dims, grids, near, True), "t byte, id long, cell long, visits boolean, v binary")
    # Cells of one row, and those beyond a face that no row lives in, link nothing: their rows are not exchanged.
    held = counts.count()
    if small_enough(held, 16):
        full = full.join(F.broadcast(counts.select("cell")), "cell", "left_semi")
    crowded = written(counts.where((F.col("n") > block) | (F.col("m") > block)).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("m") / block).cast("int").alias("more")), "crowded")
    crowds = crowded.count()
    if crowds:
        large = F.broadcast(crowded) if small_enough(crowds, 16) else crowded
        full = full.join(large, "cell", "left")
        # Blocks 0 to blocks - 1 live in the cell, those after them visit.  A row of block k is the left side of the pairs (k, j) for j >= k and the
        # right side of (j, k) for j < k; visitors meet the blocks that live there only.
        salt = F.xxhash64("id")
        own = F.when(F.col("visits"), F.col("blocks") + F.pmod(salt, F.greatest("more", F.lit(1)))).otherwise(F.pmod(salt, F.col("blocks"))).cast("int")
        full = full.withColumn("own", own).withColumn("last", F.when(F.col("visits"), F.col("blocks")).otherwise(F.col("blocks") + F.col("more")) - 1)
        code = lambda j: F.least(j, F.col("own")) * (F.col("blocks") + F.col("more")) + F.greatest(j, F.col("own"))
        pair = F.transform(F.sequence(F.lit(0), F.col("last")), lambda j: F.struct(code(j).cast("int").alias("pair"), F.when(j >= F.col("own"), 0).otherwise(1).cast("byte").alias("side")))
        whole = F.array(F.struct(F.lit(-1).alias("pair"), F.col("visits").cast("byte").alias("side")))
        full = full.withColumn("p", F.explode(F.when(F.col("blocks").isNull(), whole).otherwise(pair))).select("t", "cell", F.col("p.pair").alias("pair"), F.col("p.side").alias("side"), "id", "v")
    else:
        full = full.select("t", "cell", F.lit(-1).alias("pair"), F.col("visits").cast("byte").alias("side"), "id", "v")
    placed = full.repartition("t", "cell", "pair").sortWithinPartitions("t", "cell", "pair")
    links = written(placed.mapInArrow(_linked(threshold), "t byte, a long, b long, sure boolean").distinct(), "similar")
    sure, doubt = links.where("sure").select("t", "a", "b"), links.where("NOT sure").select("t", "a", "b")
    if doubt.limit(1).count():
        ends = written(doubt.select("t", F.col("a").alias("id")).union(doubt.select("t", F.col("b").alias("id"))).distinct(), "ends")
        exact = semi_join(rows, ends, ["t", "id"]).mapInArrow(_raw, "t byte, id long, v binary").groupBy("t", "id").agg(F.first("v").alias("v"))
        met = doubt.join(exact.select("t", F.col("id").alias("a"), F.col("v").alias("x")), ["t", "a"]).join(exact.select("t", F.col("id").alias("b"), F.col("v").alias("y")), ["t", "b"])
        sure = sure.union(met.select("t", "a", "b", "x", "y").mapInArrow(_exact(threshold), "t byte, a long, b long"))
    if copies is not None:
        heads = copies[1].where("r = 1").select("t", "h", F.col("id").alias("b"))
        sure = sure.union(copies[0].join(heads, ["t", "h"]).select("t", F.col("id").alias("a"), "b"))
    node = lambda c: F.struct("t", F.col(c).alias("id"))
    found = connected_components(sure.select(node("a").alias("a"), node("b").alias("b")))
    labels = written(found.select(F.col("id.t").alias("t"), F.col("id.id").alias("id"), F.col("component.id").alias("cluster_id")).select(name.alias("tab"), "id", "cluster_id"), "labels")
    for table in (counts, crowded, links):
        dropped(table)
    first = every.mapInArrow(_keyed(dims, 1, 0.0, False), "t byte, id long, cell long, visits boolean")
    return labels, first.select(name.alias("tab"), "id", "cell")


def cluster_members(labels: DataFrame, least: int = 3) -> DataFrame:
    """(tab, id, cluster_id) of the records in clusters of at least ``least``."""
    large = labels.groupBy("tab", "cluster_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).drop("n")
    return labels.join(large, ["tab", "cluster_id"]).select("tab", "id", "cluster_id")


def describe_clusters(labels: DataFrame, cells: DataFrame, least: int = 3, typical: int = 5) -> DataFrame:
    """(tab, cluster_id, size, cells, densest, typical): size, number of cells, rows of the densest cell and its smallest ids.

    Of cells with equal counts the one with the smallest member is the densest.
    """
    kept = cluster_members(labels, least)
    placed = written(kept.join(cells.distinct(), ["tab", "id"]), "placed")
    per_cell = placed.groupBy("tab", "cluster_id", "cell").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    best = per_cell.groupBy("tab", "cluster_id").agg(F.sum("n").alias("size"), F.count("*").alias("cells"), F.max(F.struct("n", (-F.col("low")).alias("neg"), "cell")).alias("top"))
    best = best.select("tab", "cluster_id", "size", "cells", F.col("top.n").alias("densest"), F.col("top.cell").alias("cell"))
    inside = placed.join(best.select("tab", "cluster_id", "cell"), ["tab", "cluster_id", "cell"])
    # The smallest ids in two steps, so that no task sees a whole cell.
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    first = inside.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("tab", "cluster_id", "part").orderBy("id"))).where(F.col("r") <= typical)
    second = first.withColumn("r", F.row_number().over(Window.partitionBy("tab", "cluster_id").orderBy("id"))).where(F.col("r") <= typical)
    names = second.groupBy("tab", "cluster_id").agg(F.array_sort(F.collect_list("id")).alias("typical"))
    return best.drop("cell").join(names, ["tab", "cluster_id"])
