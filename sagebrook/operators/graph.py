"""Neighbours, traversal and membership on an edge table.

Traversal moves all start nodes at once: a level is one join of the frontier with the edges and one anti-join
with what was seen; levels are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.operators.fusion import first_of_each
from sagebrook.storage import written


def _directed(edges: DataFrame, direction: str, edge_type: str | None) -> DataFrame:
    """(src, dst, edge_type, weight) along the direction."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"unknown direction {direction}")
    rows = edges if edge_type is None else edges.where(F.col("type") == edge_type)
    out = rows.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), F.col("type").alias("edge_type"), "weight")
    back = rows.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"), F.col("type").alias("edge_type"), "weight")
    return out if direction == "out" else back if direction == "in" else out.unionAll(back)


def neighbours(entities: DataFrame, edges: DataFrame, nodes: list[int] | DataFrame, direction: str = "both", edge_type: str | None = None, limit: int | None = 10, unique: bool = False) -> DataFrame:
    """Neighbours (node, id, type, name, edge_type, weight) of nodes, at most ``limit`` of each by (id, edge_type, weight).

    ``both`` keeps a neighbour once an edge unless ``unique``; unknown nodes and types have none.
    """
    steps = _directed(edges, direction, edge_type)
    if isinstance(nodes, DataFrame):
        steps = steps.join(nodes.select(F.col(nodes.columns[0]).alias("src")).distinct(), "src", "left_semi")
    else:
        steps = steps.where(F.col("src").isin([int(n) for n in nodes]))
    if unique:
        steps = first_of_each(steps, ["src", "dst"], ["edge_type", "weight"])
    found = steps.join(entities.select(F.col("id").alias("dst"), "type", "name"), "dst").select(F.col("src").alias("node"), F.col("dst").alias("id"), "type", "name", "edge_type", "weight")
    if limit is None:
        return found
    w = Window.partitionBy("node").orderBy("id", "edge_type", "weight")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def traverse(edges: DataFrame, starts: DataFrame, max_depth: int = 2, direction: str = "out", edge_type: str | None = None, limit: int | None = None, merge: bool = False) -> DataFrame:
    """Breadth first: (start, id, depth), every node once a start at its least depth, the start itself at 0.

    ``starts`` has the start ids in its first column.  With ``merge`` all starts are one search and the result is
    (id, depth).  ``limit`` keeps the first of each start by (depth, id).
    """
    steps = _directed(edges, direction, edge_type).select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    first = starts.select(F.col(starts.columns[0]).alias("id")).where("id IS NOT NULL").distinct()
    seen = first.select((F.lit(0).cast("long") if merge else F.col("id")).alias("start"), "id", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = frontier.join(steps, frontier["id"] == steps["src"]).select("start", F.col("dst").alias("id")).distinct()
        frontier = written(reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(frontier)
        if not frontier.limit(1).count():
            break
    if limit is not None:
        w = Window.partitionBy("start").orderBy("depth", "id")
        seen = seen.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")
    return seen.drop("start") if merge else seen


def paths(edges: DataFrame, starts: DataFrame, max_depth: int = 2, direction: str = "out", edge_type: str | None = None) -> DataFrame:
    """All simple paths: (start, id, depth, path), a node once a path.  Ordered by (depth, id) it is the breadth-first
    listing, by (path, depth) the depth-first one."""
    steps = _directed(edges, direction, edge_type).select("src", "dst")
    now = starts.select(F.col(starts.columns[0]).alias("start")).distinct().select("start", F.col("start").alias("id"), F.lit(0).alias("depth"), F.array("start").alias("path"))
    out = now
    for depth in range(1, max_depth + 1):
        now = now.join(steps, now["id"] == steps["src"]).where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("id"), F.lit(depth).alias("depth"), F.concat("path", F.array("dst")).alias("path"))
        out = out.unionByName(now)
    return out


def depth_first(edges: DataFrame, starts: DataFrame, max_depth: int = 2, direction: str = "out", edge_type: str | None = None, limit: int | None = 100) -> DataFrame:
    """Depth first with a visited set: (start, id, depth, visit); depth and order are those of the first visit.

    The order is sequential by nature.  Each start's reachable part, bounded by ``max_depth``, is one task of its own;
    neighbours are taken by ascending id and nodes first met at ``max_depth`` are not gone beyond.  ``limit`` cuts the visits of a start; None
    takes all.
    """
    steps = _directed(edges, direction, edge_type).select("src", "dst").distinct()
    near = traverse(edges, starts, max_depth, direction, edge_type)
    local = near.join(steps, near["id"] == steps["src"], "left").select("start", F.col("id").alias("src"), "dst")

    def run(key, pdf):
        import pandas as pd

        start = key[0]
        links = {int(s): sorted({int(d) for d in g["dst"].dropna()}, reverse=True) for s, g in pdf.groupby("src")}
        stack, seen, out = [(int(start), 0)], set(), []
        while stack and (limit is None or len(out) < limit):
            node, depth = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            out.append((start, node, depth, len(out)))
            if depth < max_depth:
                stack.extend((n, depth + 1) for n in links.get(node, []) if n not in seen)
        return pd.DataFrame(out, columns=["start", "id", "depth", "visit"])

    return local.groupBy("start").applyInPandas(run, "start long, id long, depth int, visit int")


def community_members(communities: DataFrame, entities: DataFrame, ids: list[int] | None = None) -> DataFrame:
    """(community_id, id, type, name) of the stored members; a repeated member counts once."""
    rows = communities if ids is None else communities.where(F.col("id").isin(ids))
    pairs = rows.select(F.col("id").alias("community_id"), F.explode(F.array_distinct("entity_ids")).alias("id")).where("id IS NOT NULL").distinct()
    return pairs.join(entities.select("id", "type", "name"), "id").select("community_id", "id", "type", "name")


def relations_within(members: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of which both ends are members of one community: (community_id, id, from_id, to_id, type, weight)."""
    a = members.select("community_id", F.col("id").alias("from_id"))
    b = members.select("community_id", F.col("id").alias("to_id"))
    return edges.select("id", "from_id", "to_id", "type", "weight").join(a, "from_id").join(b, ["community_id", "to_id"]).select("community_id", "id", "from_id", "to_id", "type", "weight")


def entities_of_chunks(entities: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Entities that cite any of the chunks (first column of ``chunk_ids``)."""
    wanted = chunk_ids.select(F.col(chunk_ids.columns[0]).alias("c")).distinct()
    ids = entities.select("id", F.explode("source_chunk_ids").alias("c")).join(wanted, "c", "left_semi").select("id").distinct()
    return entities.join(ids, "id", "left_semi")


def chunks_of_entities(entities: DataFrame, chunks: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """Chunks cited by entities, each once, with ``depth``: the least depth of an entity that cites it, else 0.

    ``depths`` is (id, depth) of entities.
    """
    cited = entities.select("id", F.explode("source_chunk_ids").alias("chunk_id")).where("chunk_id IS NOT NULL")
    if depths is not None:
        cited = cited.join(depths.select("id", "depth"), "id", "left")
    else:
        cited = cited.withColumn("depth", F.lit(0))
    least = cited.groupBy("chunk_id").agg(F.min(F.coalesce("depth", F.lit(0))).alias("depth"))
    return chunks.join(least, chunks["id"] == least["chunk_id"]).drop("chunk_id")


def entities_by_vector(entities: DataFrame, query: list[float], limit: int = 10, type_: str | None = None, copies: bool = False) -> DataFrame:
    """The nearest entities; the type filter is applied before the top-k."""
    from sagebrook.operators.search import semantic

    return semantic(entities, query, limit, None if type_ is None else F.col("type") == type_, copies=copies)


def entities_by_chunks(entities: DataFrame, chunks: DataFrame, query: list[float], limit: int = 10, type_: str | None = None) -> DataFrame:
    """Entities that cite the nearest chunks, by the best rank of a chunk they cite, then id."""
    from sagebrook.operators.search import semantic

    near = semantic(chunks.select("id", "embedding"), query, limit * 2).select(F.col("id").alias("c"), F.row_number().over(Window.orderBy("distance", "id")).alias("r"))
    rows = entities if type_ is None else entities.where(F.col("type") == type_)
    best = rows.select("id", F.explode("source_chunk_ids").alias("c")).join(F.broadcast(near), "c").groupBy("id").agg(F.min("r").alias("r"))  # 2 * limit rows
    return rows.join(best, "id").orderBy("r", "id").limit(limit)
