"""Communities by label propagation, their hierarchy and their descriptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebrook.functions.text import rendered
from sagebrook.operators.components import connected_components
from sagebrook.operators.graph import community_members, relations_within
from sagebrook.storage import dropped, written

PROMPT = "Summarise what this community of entities is about.\n\nEntities:\n{entities}\n\nRelationships:\n{relationships}"


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, other), both ways; repeated edges are kept, a loop counts twice."""
    rows = edges.where("from_id IS NOT NULL AND to_id IS NOT NULL")
    return rows.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionAll(rows.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))


def _exact(max_rounds: int):
    def run(pdf):
        links: dict[int, list[int]] = {}
        for a, b in zip(pdf["id"], pdf["other"]):
            links.setdefault(int(a), []).append(int(b))
        label = {n: n for n in links}
        for _ in range(max_rounds):
            changed = False
            for n in sorted(links):
                votes: dict[int, int] = {}
                for m in links[n]:
                    votes[label[m]] = votes.get(label[m], 0) + 1
                best = min(votes, key=lambda x: (-votes[x], x))
                if best != label[n]:
                    label[n], changed = best, True
            if not changed:
                break
        import pandas as pd

        return pd.DataFrame({"id": list(label), "label": list(label.values())})

    return run


def label_propagation(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100, mode: str = "distributed") -> DataFrame:
    """(id, label): every node takes the most frequent label of its neighbours, the smallest on ties; nodes without edges keep their own.

    ``exact`` updates in place by ascending id, one task a connected component: for graphs whose components fit a
    task.  ``distributed`` updates all nodes at once, a node's own label voting too; it is approximate
    and ends at a fixpoint, a label pattern seen two rounds before, or ``max_rounds``.
    Edges of unknown nodes are left out.
    """
    ids = nodes.select("id").where("id IS NOT NULL").distinct()
    known = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
    links = written(adjacency(known), "adjacency")
    if mode == "exact":
        parts = connected_components(links, "id", "other")
        found = links.join(parts, "id").groupBy("component").applyInPandas(lambda pdf: _exact(max_rounds)(pdf), "id long, label long")
    else:
        labels = written(links.select("id").distinct().withColumn("label", F.col("id")), "labels")
        past: list[tuple] = []
        for _ in range(max_rounds):
            votes = links.join(labels.select(F.col("id").alias("other"), "label"), "other").select("id", "label").unionAll(labels.select("id", "label"))
            counts = votes.groupBy("id", "label").agg(F.count("*").alias("n"))
            new = written(counts.groupBy("id").agg(F.max(F.struct("n", (-F.col("label")).alias("neg"))).alias("top")).select("id", (-F.col("top.neg")).alias("label")), "labels")
            mark = tuple(new.agg(F.bit_xor(F.xxhash64("id", "label")), F.sum(F.xxhash64("label", "id") % 1000003)).first())
            dropped(labels)
            labels = new
            if mark in past[-2:]:
                break
            past.append(mark)
        found = labels
    return ids.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def communities(labels: DataFrame, level: int = 0, most: int = 1_000_000) -> DataFrame:
    """(id, level, part, entity_ids) of labels; the label is the id.

    A community of more than ``most`` members has several rows, numbered by ``part``, so that no array and no task holds
    a community that grows with the graph.
    """
    sizes = labels.groupBy("label").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    placed = labels.join(sizes, "label").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    return placed.groupBy("label", "part").agg(F.array_sort(F.collect_list("id")).alias("entity_ids")).select(F.col("label").alias("id"), F.lit(level).alias("level"), "part", "entity_ids")


def hierarchy(nodes: DataFrame, edges: DataFrame, levels: int = 1, **options) -> DataFrame:
    """(level, id, label) for each level; a level's graph is the one before with communities as nodes.

    Edges within a community fall away.  Fewer than one level is a ValueError.
    """
    if levels < 1:
        raise ValueError("levels must be 1 or more")
    out, now, links, down = None, nodes.select("id"), edges.select("from_id", "to_id"), None
    for level in range(levels):
        labels = written(label_propagation(now, links, **options), "level")
        down = labels if down is None else written(down.join(labels.select(F.col("id").alias("label"), F.col("label").alias("up")), "label").select("id", F.col("up").alias("label")), "down")
        part = down.select(F.lit(level).alias("level"), "id", "label")
        out = part if out is None else out.unionByName(part)
        a, b = labels.select(F.col("id").alias("from_id"), F.col("label").alias("x")), labels.select(F.col("id").alias("to_id"), F.col("label").alias("y"))
        links = links.join(a, "from_id").join(b, "to_id").where("x <> y").select(F.col("x").alias("from_id"), F.col("y").alias("to_id"))
        now = labels.select(F.col("label").alias("id")).distinct()
    return out


def describe(communities_: DataFrame, entities: DataFrame, edges: DataFrame, template: str = PROMPT) -> DataFrame:
    """(community_id, prompt): members by id and relations by (from, to, type), one a line."""
    members = community_members(communities_, entities)
    names = members.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("id", "name", "type"))).alias("m"))
    lines = F.array_join(F.transform("m", lambda x: F.concat(F.lit("- "), F.coalesce(x["name"], F.lit("")), F.lit(" ("), F.coalesce(x["type"], F.lit("")), F.lit(")"))), "\n")
    title = entities.select("id", "name")
    within = relations_within(members, edges).join(title.select(F.col("id").alias("from_id"), F.col("name").alias("a")), "from_id").join(title.select(F.col("id").alias("to_id"), F.col("name").alias("b")), "to_id")
    relations = within.groupBy("community_id").agg(F.array_sort(F.collect_list(F.struct("from_id", "to_id", "type", "a", "b"))).alias("r"))
    said = F.array_join(F.transform("r", lambda x: F.concat(F.lit("- "), x["a"], F.lit(" "), F.coalesce(x["type"], F.lit("")), F.lit(" "), x["b"])), "\n")
    both = names.join(relations, "community_id", "left")
    return both.select("community_id", rendered(template, entities=lines, relationships=said).alias("prompt"))


def summarise(communities_: DataFrame, entities: DataFrame, edges: DataFrame, generate: Callable[[list[str]], list[str]]) -> DataFrame:
    """Communities with ``summary`` from a text model; failed calls leave it null and are named in ``error``."""
    from sagebrook.models import complete

    answers = complete(describe(communities_, entities, edges), generate).select(F.col("community_id").alias("id"), F.col("response").alias("summary"), "error")
    return communities_.drop("summary").join(answers, "id", "left")


def detect_and_summarise(nodes: DataFrame, edges: DataFrame, entities: DataFrame, generate: Callable[[list[str]], list[str]], **options) -> DataFrame:
    return summarise(communities(label_propagation(nodes, edges, **options)), entities, edges, generate)
