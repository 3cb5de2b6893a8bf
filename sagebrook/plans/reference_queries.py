"""Queries on references between the graph and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrook.operators.references import OrphanLedger, Reference, references

SPECS = [
    Reference("graph_edges", "from_id", "graph_entities"),
    Reference("graph_edges", "to_id", "graph_entities"),
    Reference("graph_entities", "source_chunk_ids", "rag_chunks"),
    Reference("graph_communities", "entity_ids", "graph_entities"),
]


def ledger(spark: SparkSession, folder: str, batches: int = 2) -> OrphanLedger:
    """State after all rows, taken in batches of equal spans of the edges' time."""
    read = lambda t, *c: spark.read.parquet(f"{folder}/{t}.parquet").select(*c)
    tables = {
        "graph_edges": read("graph_edges", "id", "from_id", "to_id", "inserted_at"),
        "graph_entities": read("graph_entities", "id", "source_chunk_ids", "inserted_at"),
        "graph_communities": read("graph_communities", "id", "entity_ids", "inserted_at"),
    }
    parents = None
    for target in ("rag_chunks", "graph_entities"):
        one = read(target, F.lit(target).alias("target"), F.col("id").alias("key"), F.col("inserted_at").alias("at"))
        parents = one if parents is None else parents.unionByName(one)
    deletions = read("deletion_log", F.col("tab").alias("target"), F.col("rec_id").alias("key"), F.col("deleted_at").alias("at"))
    out = OrphanLedger(spark)
    first, last = tables["graph_edges"].agg(F.min("inserted_at"), F.max("inserted_at")).first()
    times = [F.lit(first + (last - first) * k / batches) for k in range(1, batches)] if first else []
    for low, high in zip([None, *times], [*times, None]):

        def part(df: DataFrame, at: str, low=low, high=high) -> DataFrame:
            if low is None:
                return df.where((F.col(at) < high) | F.col(at).isNull()) if high is not None else df
            return df.where(F.col(at) >= low) if high is None else df.where((F.col(at) >= low) & (F.col(at) < high))

        now = {t: part(df, "inserted_at") for t, df in tables.items()}
        out.ingest(references(now, SPECS), part(parents, "at"), part(deletions, "at"))
    return out


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """References that lead to no stored record."""
    return ledger(spark, folder).orphans()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    """Their counts by referring table, field, kind and month."""
    return ledger(spark, folder).snapshot()


QUERIES = {"p4_found": p4_found, "p4_report": p4_report}

_FOUND = """
WITH refs AS (
  SELECT 'graph_edges' AS tab, 'from_id' AS field, id AS rec_id, from_id AS ref_id, 'graph_entities' AS target, inserted_at AS seen FROM graph_edges
  UNION SELECT 'graph_edges', 'to_id', id, to_id, 'graph_entities', inserted_at FROM graph_edges
  UNION SELECT 'graph_entities', 'source_chunk_ids', id, unnest(source_chunk_ids), 'rag_chunks', inserted_at FROM graph_entities
  UNION SELECT 'graph_communities', 'entity_ids', id, unnest(entity_ids), 'graph_entities', inserted_at FROM graph_communities),
parents AS (
  SELECT 'rag_chunks' AS target, id AS key, max(inserted_at) AS born FROM rag_chunks GROUP BY id
  UNION ALL SELECT 'graph_entities', id, max(inserted_at) FROM graph_entities GROUP BY id),
gone AS (SELECT tab AS target, rec_id AS key, max(deleted_at) AS gone FROM deletion_log GROUP BY tab, rec_id),
judged AS (SELECT r.*, CASE WHEN born IS NULL THEN 'missing' WHEN gone >= born THEN 'deleted' WHEN born > seen THEN 'late' END AS kind
  FROM refs r LEFT JOIN parents p ON p.target = r.target AND p.key = r.ref_id LEFT JOIN gone g ON g.target = r.target AND g.key = r.ref_id
  WHERE ref_id IS NOT NULL),
found AS (SELECT tab, field, rec_id, ref_id, kind, strftime(seen, '%Y-%m') AS period FROM judged WHERE kind IS NOT NULL)
"""
ORACLE = {
    "p4_found": _FOUND + "SELECT * FROM found",
    "p4_report": _FOUND + "SELECT tab, field, kind, period, count(*) AS n FROM found GROUP BY tab, field, kind, period",
}
