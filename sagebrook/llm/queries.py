"""Queries of the training-data problems, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebrook.llm import clusters, mixing, names, neardup, neighbours, quality, splitting, tokenizer
from sagebrook.storage import written


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


#: Three words a run, similarity 0.5, at least 20 words.
_NEAR = {"size": 3, "threshold": 0.5, "least_words": 20}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks with nearly the same text."""
    return neardup.similar_pairs(_read(spark, folder, "rag_chunks"), "id", "content", **_NEAR)


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The groups of such chunks, and which one of each to keep."""
    return neardup.near_duplicate_groups(_read(spark, folder, "rag_chunks"), "id", "content", **_NEAR)


def _embedded(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {t: _read(spark, folder, t).select("id", "embedding") for t in ("rag_chunks", "graph_entities")}


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records in clusters of at least three similar embeddings."""
    return clusters.cluster_members(clusters.similar_components(_embedded(spark, folder))[0])


def p2_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """Size and typical members of each cluster."""
    return clusters.describe_clusters(*clusters.similar_components(_embedded(spark, folder)))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of embeddings of which one is among the five most similar of the other, at 0.9 or more."""
    return neighbours.neighbour_pairs(neighbours.nearest(_embedded(spark, folder), 5, 0.9))


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The up to five most similar embeddings of each, at 0.9 or more, in order."""
    return neighbours.nearest(_embedded(spark, folder), 5, 0.9)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of entities whose names mean the same person or organisation."""
    return names.name_pairs(_read(spark, folder, "graph_entities"), _read(spark, folder, "name_forms"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group of every person and organisation."""
    return names.name_groups(_read(spark, folder, "graph_entities"), _read(spark, folder, "name_forms"))


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of every chunk that is too long for the format of its source."""
    return splitting.split_oversized(_read(spark, folder, "rag_chunks"), _read(spark, folder, "split_limits"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks that had to be cut."""
    return p6_pieces(spark, folder).where("piece = 0").select("id", "fmt")


def p6_cover(spark: SparkSession, folder: str) -> DataFrame:
    """Of every chunk that had to be cut: what its pieces hold, overlaps once, the least and largest overlap, and whether all are within the limit."""
    limits = _read(spark, folder, "split_limits")
    pieces = p6_pieces(spark, folder).join(F.broadcast(limits.groupBy("fmt").agg(F.max("max_chars").alias("most"))), "fmt")  # as many rows as there are formats
    order = Window.partitionBy("id").orderBy("piece")
    seen = pieces.withColumn("again", F.lag("end").over(order) - F.col("start"))
    new = F.struct("piece", F.expr("substring(text, coalesce(again, 0) + 1)").alias("t"))
    held = seen.groupBy("id", "fmt").agg(F.array_sort(F.collect_list(new)).alias("parts"), F.min("again").alias("least"), F.max("again").alias("largest"), F.bool_and(F.length("text") <= F.col("most")).alias("within"))
    return held.select("id", "fmt", F.md5(F.array_join("parts.t", "").cast("binary")).alias("text"), "least", "largest", "within")


def p6_cuts(spark: SparkSession, folder: str) -> DataFrame:
    """At which natural boundaries the cuts lie, by format."""
    return splitting.cut_quality(_read(spark, folder, "rag_chunks"), _read(spark, folder, "split_limits"))


def p7_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every text after encoding and decoding."""
    return tokenizer.decode_ids(p7_ids(spark, folder), "ids", ["doc_id"])


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return tokenizer.encode_ids(_read(spark, folder, "documents"), "text", ["doc_id"])


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sized = written(tokenizer.count_tokens(_read(spark, folder, "documents"), "text", ["doc_id", "source"]), "sized")
    return mixing.draw_mix(sized, _read(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The drawn mix, one row a use of a document, in the order of the global shuffle."""
    return _mix(spark, folder)[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The share of all tokens that each source reached."""
    return _mix(spark, folder)[1]


def p9_stats(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics and kind of every document."""
    return quality.text_kinds(_read(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are lists, tables or junk."""
    return p9_stats(spark, folder).where("kind <> 'prose'").select("doc_id", "kind")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p3_found": p3_found,
    "p3_neighbours": p3_neighbours,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_cover": p6_cover,
    "p6_cuts": p6_cuts,
    "p7_ids": p7_ids,
    "p7_text": p7_text,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_stats": p9_stats,
}

_SQL_VECTORS = """v AS (SELECT DISTINCT ON (tab, id) tab, id, embedding::DOUBLE[] AS e FROM (
  SELECT 'rag_chunks' AS tab, id, embedding FROM rag_chunks UNION ALL SELECT 'graph_entities', id, embedding FROM graph_entities)
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT a.tab, a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS s FROM v a JOIN v b ON a.tab = b.tab AND a.id <> b.id WHERE round(list_cosine_similarity(a.e, b.e), 6) >= 0.9)
"""

ORACLE: dict[str, str] = {
    "p1_found": r"""
WITH w AS (SELECT DISTINCT ON (id) id, regexp_extract_all(lower(content), '[\p{L}\p{N}]+') AS w FROM rag_chunks),
t AS (SELECT id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM w WHERE len(w) >= 20),
u AS (SELECT id, len(t) AS n, unnest(t) AS x FROM t),
c AS (SELECT a.id AS id_a, b.id AS id_b, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS common FROM u a JOIN u b ON a.x = b.x AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM c WHERE common >= 0.5 * (n + m - common)""",
    "p2_found": f"""
WITH RECURSIVE {_SQL_VECTORS}, r AS (SELECT tab, a AS id, b AS other FROM s UNION SELECT r.tab, r.id, s.b FROM r JOIN s ON s.tab = r.tab AND s.a = r.other),
l AS (SELECT tab, id, least(id, min(other)) AS cluster_id FROM r GROUP BY tab, id)
SELECT tab, id, cluster_id FROM l WHERE (tab, cluster_id) IN (SELECT (tab, cluster_id) FROM l GROUP BY tab, cluster_id HAVING count(*) >= 3)""",
    "p3_found": f"""
WITH {_SQL_VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY tab, a ORDER BY s DESC, b) AS r FROM s)
SELECT DISTINCT tab, least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE r <= 5""",
    "p6_found": r"""
WITH c AS (SELECT id, content, lower(CASE WHEN contains(part, '.') THEN regexp_extract(part, '[^.]*$') END) AS e FROM (
  SELECT id, content, regexp_extract(regexp_replace(source, '[?#](.|\n)*$', ''), '[^/]*$') AS part FROM rag_chunks)),
l AS (SELECT c.id, c.content, coalesce(k.max_chars, o.max_chars) AS m, coalesce(k.fmt, o.fmt) AS fmt, coalesce(k.overlap_chars, o.overlap_chars) AS v
  FROM c LEFT JOIN split_limits k ON k.ext = c.e CROSS JOIN (SELECT * FROM split_limits WHERE ext = 'other') o)
SELECT DISTINCT id, fmt FROM l WHERE length(content) > m""",
    "p7_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
ORACLE["p6_cover"] = ORACLE["p6_found"].replace("SELECT DISTINCT id, fmt FROM l", "SELECT DISTINCT ON (id) id, fmt, md5(content) AS text, least(v, m // 2)::INT AS least, least(v, m // 2)::INT AS largest, true AS within FROM l")
ORACLE["p3_neighbours"] = f"""
WITH {_SQL_VECTORS}, r AS (SELECT *, row_number() OVER (PARTITION BY tab, a ORDER BY s DESC, b) AS r FROM s)
SELECT tab, a AS id, r::INT AS rank, b AS neighbour, s AS similarity FROM r WHERE r <= 5"""
#: Classes of equal words, links between them, and the smallest id that a chain of links reaches.
ORACLE["p1_groups"] = ORACLE["p1_found"].replace("\nWITH w AS", "\nWITH RECURSIVE w AS").replace(
    "SELECT id_a, id_b FROM c WHERE common >= 0.5 * (n + m - common)",
    """, f AS (SELECT id_a, id_b FROM c WHERE common >= 0.5 * (n + m - common)), k AS (SELECT id, min(id) OVER (PARTITION BY w) AS class_id, count(*) OVER (PARTITION BY w) AS class_size FROM w WHERE len(w) >= 20),
x AS (SELECT DISTINCT a.class_id AS a, b.class_id AS b FROM f JOIN k a ON a.id = f.id_a JOIN k b ON b.id = f.id_b WHERE a.class_id <> b.class_id), y AS (SELECT a, b FROM x UNION SELECT b, a FROM x),
g AS (SELECT DISTINCT class_id AS a, class_id AS b FROM k UNION SELECT g.a, y.b FROM g JOIN y ON y.a = g.b), h AS (SELECT a AS class_id, min(b) AS group_id FROM g GROUP BY a), n AS (SELECT a AS class_id, count(*) AS links FROM y GROUP BY a)
SELECT k.id, group_id, k.class_id, class_size, coalesce(links, 0) AS links, k.id = group_id AS keep FROM k JOIN h ON h.class_id = k.class_id LEFT JOIN n ON n.class_id = k.class_id""",
)
