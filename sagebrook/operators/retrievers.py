"""Retrievers: one interface over vector, word, hybrid and graph search."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.functions import vector as V
from sagebrook.models import Embed
from sagebrook.operators import fusion, graph, search


@dataclass(frozen=True)
class Query:
    """A query by text, by vector, or both."""

    text: str | None = None
    embedding: list[float] | None = None


class Retriever(Protocol):
    supports_embedding: bool
    supports_text: bool

    def retrieve(self, query: Query, limit: int = 10) -> DataFrame: ...


@dataclass(frozen=True)
class Semantic:
    chunks: DataFrame
    copies: bool = False
    supports_embedding = True
    supports_text = False

    def retrieve(self, query: Query, limit: int = 10) -> DataFrame:
        if query.embedding is None:
            raise ValueError("invalid query format: a vector is needed")
        return search.semantic(self.chunks, query.embedding, limit, copies=self.copies)


@dataclass(frozen=True)
class FullText:
    chunks: DataFrame
    copies: bool = False
    supports_embedding = False
    supports_text = True

    def retrieve(self, query: Query, limit: int = 10) -> DataFrame:
        if query.text is None:
            raise ValueError("invalid query format: a text is needed")
        return search.fulltext(self.chunks.drop("embedding"), query.text, limit, copies_of="id" if self.copies else None)


@dataclass(frozen=True)
class Hybrid:
    chunks: DataFrame
    copies: bool = False
    supports_embedding = True
    supports_text = True

    def retrieve(self, query: Query, limit: int = 10) -> DataFrame:
        if query.text is None or query.embedding is None:
            raise ValueError("invalid query format: a vector and a text are needed")
        return search.hybrid(self.chunks, query.embedding, query.text, limit, copies=self.copies)


@dataclass(frozen=True)
class Graph:
    """Search through the graph: ``local`` from the nearest entities outwards, ``global`` by communities, ``hybrid`` both.

    A text query is embedded once with ``embed``; without it, it is a ValueError.  Communities need the column ``embedding`` of
    their summaries (:func:`with_summary_vectors`).
    """

    entities: DataFrame
    edges: DataFrame
    chunks: DataFrame
    communities: DataFrame | None = None
    embed: Embed | None = None
    mode: str = "local"
    depth: int = 2
    local_weight: float = 1.0
    global_weight: float = 1.0
    supports_embedding = True
    supports_text = True

    def _vector(self, query: Query) -> list[float]:
        if query.embedding is not None:
            return query.embedding
        if self.embed is None:
            raise ValueError("an embedding function is required for text queries")
        return list(self.embed([query.text or ""])[0])

    def retrieve(self, query: Query, limit: int = 10) -> DataFrame:
        vector = self._vector(query)
        if self.mode == "local":
            return self.local(vector, limit)
        if self.mode == "global":
            return self.global_(vector, limit)
        if self.mode == "hybrid":
            both = fusion.local_global_ranks(
                self.local(vector, limit).withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id"))),
                self.global_(vector, limit).withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id"))),
                self.local_weight, self.global_weight,
            )
            return both.orderBy(F.desc("score"), "id").limit(limit)
        raise ValueError(f"unknown mode {self.mode}")

    def local(self, vector: list[float], limit: int = 10) -> DataFrame:
        """Chunks cited by the nearest entities and what they reach; score 1 / (1 + least depth)."""
        seeds = search.semantic(self.entities, vector, limit).select("id")
        depths = graph.traverse(self.edges, seeds, self.depth, merge=True)
        reached = self.entities.select("id", "source_chunk_ids").join(depths, "id", "left_semi")
        found = graph.chunks_of_entities(reached, self.chunks.select("id", "content", "source", "metadata"), depths)
        meta = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "graph_depth"), F.create_map(F.lit("graph_depth"), F.col("depth").cast("string")))
        scored = found.select(F.col("id").cast("string").alias("id"), "content", "source", meta.alias("metadata"), (1 / (1 + F.col("depth"))).alias("score"), F.col("id").alias("n"))
        return scored.orderBy(F.desc("score"), "n").limit(limit).drop("n")

    def global_(self, vector: list[float], limit: int = 10) -> DataFrame:
        """Summaries of the nearest communities; score 1 / (1 + rank)."""
        if self.communities is None:
            raise ValueError("no communities are configured")
        rows = self.communities.where("summary IS NOT NULL AND summary <> ''").withColumn("distance", V.l2(F.col("embedding"), V.literal(vector))).where("distance IS NOT NULL")
        top = rows.orderBy("distance", "id").limit(limit).withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")) - 1)
        meta = F.create_map(F.lit("level"), F.col("level").cast("string"), F.lit("entity_count"), F.size("entity_ids").cast("string"))
        return top.select(F.concat(F.lit("community_"), F.col("id").cast("string")).alias("id"), F.col("summary").alias("content"), F.lit(None).cast("string").alias("source"), meta.alias("metadata"), (1 / (1 + F.col("rank"))).alias("score"))


def with_summary_vectors(communities: DataFrame, embed: Embed) -> DataFrame:
    """Communities with the embeddings of their summaries."""
    from sagebrook import models

    return models.embed(communities, embed, "summary").drop("error")
