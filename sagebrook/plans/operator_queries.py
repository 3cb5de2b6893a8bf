"""Queries of stores, traversal orders, triples, models and generation over the test tables, with the SQL that says the same.

Models are rules here: vectors count letters, answers follow from the length of the prompt, so that SQL can say what they give.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebrook import models, schemas
from sagebrook.functions import chunkers
from sagebrook.operators import chunking, community, extraction, generation, graph, rerank, retrievers, search, triples
from sagebrook.plans.engine_queries import _SQL_CHUNKS, _SQL_DISTANCE, _SQL_EDGES, _SQL_ENTITIES, _SQL_Q, _SQL_STORE, ORACLE as ENGINE_ORACLE
from sagebrook.plans.engine_queries import _chunks, _edges, _entities, _ranked_docs, _SQL_RANKED, _store, _t, _vector
from sagebrook.sources import vector_index
from sagebrook.sources.snapshots import ChunkStore, GraphStore, from_chunks
from sagebrook.storage import shared_folder

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return keep


def _path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


# --- models by rule ---

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(texts: list[str]) -> list[list[float]]:
    """How often each letter is in a text, and zeros up to 64 numbers."""
    return [[float((t or "").lower().count(c)) for c in LETTERS] + [0.0] * (64 - len(LETTERS)) for t in texts]


def _sql_letters(text: str) -> str:
    return f"list_concat(list_transform(string_split('{','.join(LETTERS)}', ','), lambda c: (length(lower({text})) - length(replace(lower({text}), c, '')))::DOUBLE), list_transform(range({64 - len(LETTERS)}), lambda c: 0.0::DOUBLE))"


def yes_or_no(prompts: list[str]) -> list[str]:
    return ["YES" if len(p) % 2 else "NO" for p in prompts]


def _sql_rendered(template: str, **values: str) -> str:
    """The template filled in the order of the values."""
    out = "'" + template.replace("'", "''") + "'"
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', coalesce({value}, ''))"
    return out


# --- stores ---


@query(
    "store_lookup",
    f"""WITH c AS ({_SQL_CHUNKS}) SELECT id, source FROM c WHERE regexp_replace(content, '[ \\t\\n\\v\\f\\r]', '', 'g') <> '' AND id IN (SELECT rec_id FROM deletion_log WHERE tab = 'rag_chunks')""",
)
def store_lookup(spark, folder):
    """Point lookup by a table of keys."""
    store = ChunkStore(spark, _path(spark, "store"))
    store.insert(_chunks(spark, folder))
    return store.get(_t(spark, folder, "deletion_log").where("tab = 'rag_chunks'").select("rec_id")).select("id", "source")


@query("store_search", f"""WITH q AS ({_SQL_Q}), c AS ({_SQL_CHUNKS}), d AS (SELECT id, source, {_SQL_DISTANCE} AS d FROM c, q WHERE regexp_replace(content, '[ \\t\\n\\v\\f\\r]', '', 'g') <> '')
SELECT id, source, true AS has_metadata, round(1 / (1 + d), 6) AS score FROM d WHERE d IS NOT NULL ORDER BY d, id LIMIT 10""")
def store_search(spark, folder):
    """The store's own search; metadata of a result is never null."""
    store = ChunkStore(spark, _path(spark, "store"))
    store.insert(_chunks(spark, folder))
    return store.search(_vector(spark, folder)).select("id", "source", F.col("metadata").isNotNull().alias("has_metadata"), F.round("score", 6).alias("score"))


@query("index_search", f"""WITH q AS ({_SQL_Q}), c AS ({_SQL_CHUNKS}), d AS (SELECT id, {_SQL_DISTANCE} AS d FROM c, q) SELECT id, round(d, 6) AS distance FROM d WHERE d IS NOT NULL ORDER BY d, id LIMIT 10""")
def index_search(spark, folder):
    """The inverted-list layout with all lists probed, which is exact."""
    path = _path(spark, "lists")
    vector_index.write_index(_chunks(spark, folder).select("id", "embedding"), path, lists=20)
    return vector_index.search_index(spark, path, _vector(spark, folder), 10, probes=20).select("id", F.round("distance", 6).alias("distance"))


_SQL_GOOD_ENTITIES = f"SELECT id FROM ({_SQL_ENTITIES}) WHERE type IS NOT NULL AND trim(type) <> '' AND lower(type) <> 'nil' AND name IS NOT NULL AND trim(name) <> ''"


@query("store_given_ids", f"WITH g AS ({_SQL_GOOD_ENTITIES}) SELECT count(*) AS stored, 1::BIGINT AS lowest, count(*) AS highest, count(*) AS keys FROM g")
def store_given_ids(spark, folder):
    """Entities stored without ids are numbered from 1; refused ones take no number."""
    store = GraphStore(spark, _path(spark, "graph"))
    store.create_nodes(_entities(spark, folder).drop("id"))
    return store.get_all_entities().agg(F.count("*").alias("stored"), F.min("id").alias("lowest"), F.max("id").alias("highest"), F.count_distinct("id").alias("keys"))


def _graph_store(spark, folder):
    store = GraphStore(spark, _path(spark, "graph"))
    store.create_nodes(_entities(spark, folder))
    return store


@query(
    "store_edges",
    f"""WITH g AS ({_SQL_GOOD_ENTITIES}), e AS ({_SQL_EDGES}) SELECT id, from_id, to_id, type, coalesce(weight, 1.0) AS weight FROM e
WHERE from_id IN (SELECT id FROM g) AND to_id IN (SELECT id FROM g) AND from_id <> to_id AND trim(type) <> '' AND coalesce(weight, 1.0) BETWEEN 0 AND 1""",
)
def store_edges(spark, folder):
    store = _graph_store(spark, folder)
    store.create_edges(_edges(spark, folder))
    return store.get_all_edges().select("id", "from_id", "to_id", "type", "weight")


_SQL_LARGEST = "SELECT list_sort(list_distinct(list_filter(entity_ids, lambda x: x IS NOT NULL))) AS ids FROM graph_communities ORDER BY len(list_distinct(list_filter(entity_ids, lambda x: x IS NOT NULL))) DESC, id LIMIT 1"


@query(
    "store_relationships_between",
    f"""WITH g AS ({_SQL_GOOD_ENTITIES}), e AS ({_SQL_EDGES}), m AS (SELECT unnest(ids) AS id FROM ({_SQL_LARGEST})) SELECT id, from_id, to_id FROM e
WHERE from_id IN (SELECT id FROM g) AND to_id IN (SELECT id FROM g) AND from_id <> to_id AND trim(type) <> '' AND coalesce(weight, 1.0) BETWEEN 0 AND 1 AND from_id IN (SELECT id FROM m) AND to_id IN (SELECT id FROM m)""",
)
def store_relationships_between(spark, folder):
    """Edges between the members of the largest community."""
    store = _graph_store(spark, folder)
    store.create_edges(_edges(spark, folder))
    ids = F.array_sort(F.array_distinct(F.filter("entity_ids", lambda x: x.isNotNull())))
    top = _t(spark, folder, "graph_communities").select("id", ids.alias("ids")).orderBy(F.desc(F.size("ids")), "id").first()
    return store.get_relationships_between(list(top.ids) if top else []).select("id", "from_id", "to_id")


@query("store_summaries", "SELECT id, CASE WHEN summary IS NULL THEN 'none' ELSE upper(summary) END AS summary FROM graph_communities WHERE level >= 0 AND len(entity_ids) > 0")
def store_summaries(spark, folder):
    """All summaries set anew in the stored communities."""
    store = GraphStore(spark, _path(spark, "graph"))
    rows = _t(spark, folder, "graph_communities")
    store.create_communities(rows)
    store.communities.update(rows.select("id", F.coalesce(F.upper("summary"), F.lit("none")).alias("summary")), "summary")
    return store.communities.read().select("id", "summary")


@query("store_rows_of_chunks", ENGINE_ORACLE["chunk_sentences"].replace("SELECT doc_id, (generate", "SELECT doc_id, 'docs' AS source, (generate").replace("::INT AS index", "::VARCHAR AS chunk_index"))
def store_rows_of_chunks(spark, folder):
    """Chunker output as rows of the chunk store."""
    parts = chunking.chunk(_t(spark, folder, "documents").select("doc_id", "text"), chunkers.Sentence(1 << 30), "text", ["doc_id"])
    return from_chunks(parts, "docs").select("doc_id", "source", F.col("metadata")["chunk_index"].alias("chunk_index"), "content")


# --- graph ---


@query(
    "neighbours_by_type",
    f"""WITH e AS ({_SQL_EDGES}), n AS ({_SQL_ENTITIES}), r AS (SELECT from_id AS node, n.id, n.type, n.name, e.type AS edge_type, weight, row_number() OVER (PARTITION BY from_id ORDER BY n.id, e.type, weight NULLS FIRST) AS r
  FROM e JOIN n ON n.id = e.to_id WHERE e.type = 'part_of' AND from_id IS NOT NULL) SELECT node, id, type, name, edge_type, weight FROM r WHERE r <= 10""",
)
def neighbours_by_type(spark, folder):
    known = _edges(spark, folder)
    return graph.neighbours(_entities(spark, folder), known, known.select("from_id").where("from_id IS NOT NULL").distinct(), "out", "part_of")


@query(
    "neighbours_unique",
    f"""WITH e AS ({_SQL_EDGES}), n AS ({_SQL_ENTITIES}), s AS (SELECT from_id AS node, to_id AS id, type AS edge_type, weight FROM e UNION ALL SELECT to_id, from_id, type, weight FROM e),
u AS (SELECT *, row_number() OVER (PARTITION BY node, id ORDER BY edge_type NULLS FIRST, weight NULLS FIRST) AS u FROM s WHERE node IS NOT NULL),
r AS (SELECT node, n.id, n.name, edge_type, row_number() OVER (PARTITION BY node ORDER BY n.id) AS r FROM u JOIN n ON n.id = u.id WHERE u = 1) SELECT node, id, name, edge_type FROM r WHERE r <= 10""",
)
def neighbours_unique(spark, folder):
    known = _edges(spark, folder)
    every = known.select(F.col("from_id").alias("id")).union(known.select("to_id")).where("id IS NOT NULL").distinct()
    return graph.neighbours(_entities(spark, folder), known, every, "both", unique=True).select("node", "id", "name", "edge_type")


@query(
    "entities_by_chunks",
    f"""WITH q AS ({_SQL_Q}), c AS ({_SQL_CHUNKS}), d AS (SELECT id, {_SQL_DISTANCE} AS d FROM c, q), s AS (SELECT id AS c, row_number() OVER (ORDER BY d, id) AS r FROM d WHERE d IS NOT NULL ORDER BY d, id LIMIT 20),
x AS (SELECT id, name, unnest(source_chunk_ids) AS c FROM ({_SQL_ENTITIES})) SELECT id, any_value(name) AS name, min(r)::INT AS r FROM x JOIN s ON s.c = x.c GROUP BY id ORDER BY min(r), id LIMIT 10""",
)
def entities_by_chunks(spark, folder):
    """Entities that cite the nearest chunks."""
    return graph.entities_by_chunks(_entities(spark, folder), _chunks(spark, folder), _vector(spark, folder)).select("id", "name", "r")


@query(
    "dfs_listing",
    f"""WITH RECURSIVE e AS ({_SQL_EDGES}), n AS (SELECT DISTINCT id FROM graph_entities),
g AS (SELECT id AS start, id, 0 AS depth, [id] AS path FROM n UNION SELECT start, to_id, depth + 1, list_append(path, to_id) FROM g JOIN e ON e.from_id = g.id WHERE depth < 2 AND to_id IS NOT NULL AND NOT list_contains(path, to_id))
SELECT start, id, depth, (row_number() OVER (PARTITION BY start ORDER BY path))::INT AS place FROM g""",
)
def dfs_listing(spark, folder):
    """Simple paths in the order of a depth-first walk."""
    edges = _edges(spark, folder).where("to_id IS NOT NULL").select("from_id", "to_id", F.lit("x").alias("type"), F.lit(1.0).alias("weight")).distinct()
    found = graph.paths(edges, _entities(spark, folder).select("id"), 2)
    return found.select("start", "id", "depth", F.row_number().over(Window.partitionBy("start").orderBy("path")).alias("place"))


@query(
    "dfs_visits",
    f"""WITH RECURSIVE a AS (SELECT from_id AS id, list(DISTINCT to_id) AS o FROM ({_SQL_EDGES}) WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY from_id),
n AS (SELECT DISTINCT id FROM graph_entities),
g AS (SELECT id AS start, [{{'n': id, 'd': 0}}] AS stack, []::BIGINT[] AS seen, NULL::BIGINT AS id, NULL::INT AS depth, NULL::INT AS visit FROM n
UNION ALL SELECT g.start, list_concat(CASE WHEN list_contains(g.seen, g.stack[1].n) OR g.stack[1].d >= 2 THEN [] ELSE list_transform(list_sort(list_filter(coalesce(a.o, []), lambda x: NOT list_contains(g.seen, x) AND x <> g.stack[1].n)), lambda x: {{'n': x, 'd': g.stack[1].d + 1}}) END, g.stack[2:]),
  CASE WHEN list_contains(g.seen, g.stack[1].n) THEN g.seen ELSE list_append(g.seen, g.stack[1].n) END, CASE WHEN list_contains(g.seen, g.stack[1].n) THEN NULL ELSE g.stack[1].n END, g.stack[1].d, len(g.seen)::INT
  FROM g LEFT JOIN a ON a.id = g.stack[1].n WHERE len(g.stack) > 0)
SELECT start, id, depth, visit FROM g WHERE id IS NOT NULL""",
)
def dfs_visits(spark, folder):
    """Depth first with a visited set, from every entity, without a limit."""
    return graph.depth_first(_edges(spark, folder), _entities(spark, folder).select("id"), 2, limit=None)


def _sql_in_place(x: str, nodes: str, edges: str) -> str:
    """Tables, named by ``x``, that end in labels{x}(id, label): one node a step; ``changed`` tells at the end of a round whether another follows."""
    return f"""n{x} AS (SELECT DISTINCT id FROM {nodes}), e{x} AS (SELECT from_id AS a, to_id AS b FROM {edges} WHERE from_id IN (SELECT id FROM n{x}) AND to_id IN (SELECT id FROM n{x})),
l{x} AS (SELECT a AS id, b AS other FROM e{x} UNION ALL SELECT b, a FROM e{x}), p{x} AS (SELECT id, (row_number() OVER (ORDER BY id))::INT AS k FROM (SELECT DISTINCT id FROM l{x})),
adj{x} AS (SELECT p.k, list(o.k) AS o FROM l{x} l JOIN p{x} p ON p.id = l.id JOIN p{x} o ON o.id = l.other GROUP BY p.k), z{x} AS (SELECT count(*)::INT AS n, list(id ORDER BY id) AS ids FROM p{x}),
g{x} AS (SELECT 0 AS step, ids AS labels, false AS changed, false AS done FROM z{x} WHERE n > 0
UNION ALL SELECT step + 1, list_concat(list_append(labels[1:k - 1], best), labels[k + 1:]), CASE WHEN k = n THEN false ELSE changed OR best <> labels[k] END, k = n AND NOT (changed OR best <> labels[k]) FROM (
  SELECT g.step, g.labels, g.changed, adj.k, z.n, (list_sort(list_transform(map_entries(list_aggregate(list_transform(adj.o, lambda j: g.labels[j]), 'histogram')), lambda x: {{'c': -(x.value::BIGINT), 'l': x.key}}))[1]).l AS best
  FROM g{x} g, z{x} z JOIN adj{x} adj ON adj.k = g.step % z.n + 1 WHERE NOT g.done AND g.step < 100 * z.n)),
r{x} AS (SELECT labels FROM g{x} ORDER BY step DESC LIMIT 1), x{x} AS (SELECT p.id, r.labels[p.k] AS label FROM p{x} p, r{x} r), labels{x} AS (SELECT n.id, coalesce(x.label, n.id) AS label FROM n{x} n LEFT JOIN x{x} x ON x.id = n.id)"""


_SQL_IN_PLACE = "WITH RECURSIVE " + _sql_in_place("", "graph_entities", f"({_SQL_EDGES})") + " "


@query("label_propagation_in_place", _SQL_IN_PLACE + "SELECT id, label FROM labels")
def label_propagation_in_place(spark, folder):
    """Labels updated in place by ascending id."""
    return community.label_propagation(_entities(spark, folder), _edges(spark, folder), mode="exact")


@query("communities_detected", _SQL_IN_PLACE + "SELECT label AS id, 0 AS level, 0 AS part, count(*)::INT AS members FROM labels GROUP BY label")
def communities_detected(spark, folder):
    found = community.communities(community.label_propagation(_entities(spark, folder), _edges(spark, folder), mode="exact"))
    return found.select("id", "level", "part", F.size("entity_ids").alias("members"))


@query(
    "community_hierarchy",
    _SQL_IN_PLACE
    + f""", contracted AS (SELECT a.label AS from_id, b.label AS to_id FROM e JOIN labels a ON a.id = e.a JOIN labels b ON b.id = e.b WHERE a.label <> b.label), {_sql_in_place("2", "(SELECT label AS id FROM labels)", "contracted")}
SELECT 0 AS level, id, label FROM labels UNION ALL SELECT 1, l.id, u.label FROM labels l JOIN labels2 u ON u.id = l.label""",
)
def community_hierarchy(spark, folder):
    """Two levels; the second has the communities of the first as nodes."""
    return community.hierarchy(_entities(spark, folder), _edges(spark, folder), 2, mode="exact")


_SQL_PROMPTS = f"""WITH e AS ({_SQL_EDGES}), n AS ({_SQL_ENTITIES}), m AS (SELECT DISTINCT c, m.id FROM (SELECT id AS c, unnest(entity_ids) AS id FROM graph_communities) m JOIN n ON n.id = m.id),
a AS (SELECT c, string_agg('- ' || coalesce(name, '') || ' (' || coalesce(type, '') || ')', chr(10) ORDER BY n.id) AS entities FROM m JOIN n ON n.id = m.id GROUP BY c),
w AS (SELECT x.c, e.from_id, e.to_id, '- ' || p.name || ' ' || coalesce(e.type, '') || ' ' || q.name AS line, e.type FROM e JOIN m x ON x.id = e.from_id JOIN m y ON y.id = e.to_id AND y.c = x.c JOIN n p ON p.id = e.from_id JOIN n q ON q.id = e.to_id),
b AS (SELECT c, string_agg(line, chr(10) ORDER BY from_id, to_id, type) AS relationships FROM w GROUP BY c),
t AS (SELECT a.c, {_sql_rendered(community.PROMPT, entities="entities", relationships="relationships")} AS prompt FROM a LEFT JOIN b ON b.c = a.c)
"""


@query("community_summaries", _SQL_PROMPTS + "SELECT id, level, length(prompt)::VARCHAR AS summary, NULL::VARCHAR AS error FROM graph_communities g LEFT JOIN t ON t.c = g.id")
def community_summaries(spark, folder):
    """Summaries by a model that tells the length of its prompt."""
    count = lambda prompts: [str(len(p)) for p in prompts]
    return community.summarise(_t(spark, folder, "graph_communities"), _entities(spark, folder), _edges(spark, folder), count).select("id", "level", "summary", "error")


SEARCH = "the session log"
_SQL_GLOBAL = f"""d AS (SELECT id, summary, list_distance({_sql_letters("summary")}, {_sql_letters("'" + SEARCH + "'")}) AS d FROM graph_communities WHERE summary <> ''),
u AS (SELECT 'community_' || id AS id, summary AS content, 1.0 / (row_number() OVER (ORDER BY d, id)) AS score FROM d ORDER BY d, id LIMIT 10)
"""


def _graph(spark, folder, mode):
    meta = F.lit(None).cast("map<string,string>").alias("metadata")
    rows = retrievers.with_summary_vectors(_t(spark, folder, "graph_communities"), letters)
    return retrievers.Graph(_entities(spark, folder), _edges(spark, folder), _chunks(spark, folder).select("*", meta), rows, letters, mode, 2, 0.8, 0.2)


@query("global_graph_search", "WITH " + _SQL_GLOBAL + "SELECT id, content, round(score, 6) AS score FROM u")
def global_graph_search(spark, folder):
    return _graph(spark, folder, "global").retrieve(retrievers.Query(SEARCH)).select("id", "content", F.round("score", 6).alias("score"))


@query(
    "hybrid_graph_search",
    f"""WITH RECURSIVE {_SQL_GLOBAL}, q AS (SELECT {_sql_letters("'" + SEARCH + "'")} AS v), n AS ({_SQL_ENTITIES}), c AS ({_SQL_CHUNKS}), k AS (SELECT id, {_SQL_DISTANCE} AS d FROM n, q),
s AS (SELECT id FROM k WHERE d IS NOT NULL ORDER BY d, id LIMIT 10), e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM ({_SQL_EDGES}) WHERE from_id IS NOT NULL AND to_id IS NOT NULL),
g AS (SELECT id, 0 AS depth FROM s UNION SELECT b, depth + 1 FROM g JOIN e ON e.a = g.id WHERE depth < 2), m AS (SELECT id, min(depth) AS depth FROM g GROUP BY id),
x AS (SELECT unnest(n.source_chunk_ids) AS id, m.depth FROM n JOIN m ON m.id = n.id), y AS (SELECT id, min(depth) AS depth FROM x GROUP BY id),
l AS (SELECT c.id::VARCHAR AS id, c.content, y.depth FROM c JOIN y ON y.id = c.id ORDER BY y.depth, c.id LIMIT 10),
o AS (SELECT id, content, 0.8 / (60 + row_number() OVER (ORDER BY depth, id) - 1) AS p FROM l UNION ALL SELECT id, content, 0.2 / (60 + row_number() OVER (ORDER BY score DESC, id) - 1) FROM u)
SELECT id, round(sum(p), 9) AS score FROM o GROUP BY id ORDER BY sum(p) DESC, id LIMIT 10""",
)
def hybrid_graph_search(spark, folder):
    return _graph(spark, folder, "hybrid").retrieve(retrievers.Query(SEARCH)).select("id", F.round("score", 9).alias("score"))


# --- triples ---


@query(
    "triple_types",
    r"""WITH t AS (SELECT 'urn:entity:' || id AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'urn:type:' || type AS o, 'uri' AS o_type FROM graph_entities
UNION SELECT 'urn:entity:' || id, 'urn:prop:name', name, 'string' FROM graph_entities
UNION SELECT 'urn:entity:' || id, 'urn:meta:source_chunk', c::VARCHAR, 'integer' FROM (SELECT id, unnest(source_chunk_ids) AS c FROM graph_entities)
UNION SELECT 'urn:entity:' || id, 'urn:prop:' || e.key, e.value, CASE WHEN regexp_full_match(e.value, '[+-]?\d{1,18}') THEN 'integer' WHEN regexp_full_match(e.value, '[+-]?\d+\.\d+([eE][+-]?\d+)?') THEN 'float'
  WHEN e.value IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(e.value, '\s*[\[{].*[\]}]\s*', 's') THEN 'json' ELSE 'string' END FROM (SELECT id, unnest(map_entries(properties)) AS e FROM graph_entities))
SELECT s, p, o, o_type FROM t WHERE o IS NOT NULL""",
)
def triple_types(spark, folder):
    """Entities as triples with the type of the object."""
    rows = _t(spark, folder, "graph_entities").drop("embedding")
    return triples.store([triples.entity_triples(rows)]).select("s", "p", "o", "o_type")


@query("triples_without", _SQL_STORE + "SELECT s, p, o FROM t WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL AND NOT starts_with(p, 'urn:rel:')")
def triples_without(spark, folder):
    """The store after the deletion of all relationships."""
    every = _store(spark, folder)
    return triples.without(every, every.where(triples.is_relationship(F.col("p")))).where("s IS NOT NULL AND p IS NOT NULL").select("s", "p", "o")


@query("triple_index", _SQL_STORE + "SELECT s, p, o FROM t WHERE s IS NOT NULL AND p = 'urn:prop:name' AND o IS NOT NULL UNION ALL SELECT s, p, o FROM t WHERE o = 'urn:type:person' AND s IS NOT NULL AND p IS NOT NULL")
def triple_index(spark, folder):
    """Lookups by predicate and by object in the sorted copies."""
    path = _path(spark, "triples")
    triples.write_indices(_store(spark, folder), path)
    found = triples.read_index(spark, path, p=triples.PROP + "name").unionByName(triples.read_index(spark, path, o=triples.TYPE + "person"))
    return found.where("s IS NOT NULL AND p IS NOT NULL").select("s", "p", "o")


@query(
    "triple_terms",
    _SQL_STORE + r"""SELECT p, nullif(regexp_extract(p, '^urn:(entity|type|rel|prop|edge|community|meta):', 1), '') AS space, CASE WHEN regexp_matches(p, '^urn:(entity|type|rel|prop|edge|community|meta):') THEN regexp_replace(p, '^urn:[a-z]+:', '') END AS name,
starts_with(p, 'urn:rel:') AS relationship, starts_with(p, 'urn:prop:') AS property, count(*) AS uses FROM t WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL GROUP BY p""",
)
def triple_terms(spark, folder):
    """Predicates, taken apart."""
    used = _store(spark, folder).where("s IS NOT NULL AND p IS NOT NULL").groupBy("p").agg(F.count("*").alias("uses"))
    term = triples.parse_uri(F.col("p"))
    return used.select("p", term["space"].alias("space"), term["name"].alias("name"), triples.is_relationship(F.col("p")).alias("relationship"), triples.is_property(F.col("p")).alias("property"), "uses")


# --- models, extraction, reranking, generation ---


@query("embed_documents", f"SELECT doc_id, array_to_string(list_transform({_sql_letters('text')}[1:26], lambda x: x::INT), ',') AS vector FROM documents WHERE text IS NOT NULL")
def embed_documents(spark, folder):
    """Vectors of all texts, in batches."""
    done = models.embed(_t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text"), letters, "text")
    return done.where("error IS NULL").select("doc_id", F.array_join(F.transform(F.slice("embedding", 1, 26), lambda x: x.cast("int").cast("string")), ",").alias("vector"))


@query("embed_and_prepare", ENGINE_ORACLE["chunk_sentences"].replace("SELECT doc_id, (generate", "SELECT doc_id, 'docs' AS source, a, (generate").replace("unnest(l) AS content", "unnest(l) AS content").replace("SELECT doc_id, 'docs' AS source, a, ", "SELECT doc_id, source, (length(content) - length(replace(lower(content), 'a', '')))::INT AS a, index, content FROM (SELECT doc_id, 'docs' AS source, ").replace("FROM l", "FROM l)").replace("::INT AS index", "::VARCHAR AS index"))
def embed_and_prepare(spark, folder):
    """Sentences of all texts with vectors, as rows of the chunk store."""
    parts = chunking.chunk(_t(spark, folder, "documents").select("doc_id", "text"), chunkers.Sentence(1 << 30), "text", ["doc_id"])
    rows = models.EmbeddingService(letters).embed_and_prepare(parts, "docs")
    return rows.select("doc_id", "source", F.col("embedding")[0].cast("int").alias("a"), F.col("metadata")["chunk_index"].alias("index"), "content")


def _length_as_entities(prompts: list[str]) -> list[str]:
    out = []
    for p in prompts:
        name = str(len(p))
        out.append(json.dumps([{"name": name, "type": "concept"}, {"type": "event"}] if "name, type" in p else [{"source": name, "target": "x"}, {"source": name}]))
    return out


_TYPES, _RELATIONS = ", ".join(extraction.ENTITY_TYPES), ", ".join(extraction.RELATIONSHIP_TYPES)


@query(
    "extraction_of_documents",
    f"""WITH a AS (SELECT doc_id, text, length({_sql_rendered(extraction.ENTITY_PROMPT, types="'" + _TYPES + "'", text="text")})::VARCHAR AS name FROM documents WHERE text IS NOT NULL)
SELECT doc_id, name, 'concept' AS type, length({_sql_rendered(extraction.RELATIONSHIP_PROMPT, types="'" + _RELATIONS + "'", entities="name", text="text")})::VARCHAR AS source, 'x' AS target, 'related_to' AS relation FROM a""",
)
def extraction_of_documents(spark, folder):
    """Entities and relationships of every text, by a model that names lengths; what lacks a name or an end is dropped."""
    done = extraction.extract(_t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text"), _length_as_entities)
    rows = done.where("error IS NULL").select("doc_id", F.explode("entities").alias("e"), "relationships").select("doc_id", "e", F.explode("relationships").alias("r"))
    return rows.select("doc_id", F.col("e.name").alias("name"), F.col("e.type").alias("type"), F.col("r.source").alias("source"), F.col("r.target").alias("target"), F.col("r.type").alias("relation"))


@query("extraction_parse", f"SELECT id, name, coalesce(type, 'concept') AS type, coalesce(properties['role'], '') AS description, 0 AS aliases FROM (SELECT DISTINCT ON (id) id, name, type, map([]::VARCHAR[], []::VARCHAR[]) AS properties FROM graph_entities) WHERE name IS NOT NULL")
def extraction_parse(spark, folder):
    """Every entity as a model's fenced answer, read back."""
    rows = _entities(spark, folder).select("id", F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct("name", "type"))), F.lit("\n```")).alias("answer"))
    found = rows.select("id", F.explode(extraction.parse_entities(F.col("answer"))).alias("e"))
    return found.select("id", "e.name", "e.type", "e.description", F.size("e.aliases").alias("aliases"))


@query(
    "entity_resolution",
    f"""WITH n AS (SELECT name, max(type) AS type FROM ({_SQL_ENTITIES}) WHERE name IS NOT NULL AND type IS NOT NULL GROUP BY name),
g AS (SELECT lower(trim(name)) AS k, list(name ORDER BY name) AS names FROM n GROUP BY lower(trim(name)) HAVING count(*) > 1)
SELECT g.names[1] AS name, n.type, array_to_string(g.names[2:], '|') AS aliases FROM g JOIN n ON n.name = g.names[1]
UNION ALL SELECT name, type, '' FROM n WHERE name NOT IN (SELECT unnest(names) FROM g)""",
)
def entity_resolution(spark, folder):
    """Names that differ in case and outer spaces become aliases of the first."""
    rows = _entities(spark, folder).where("name IS NOT NULL AND type IS NOT NULL").groupBy("name").agg(F.max("type").alias("type")).select("name", "type", F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases"))
    groups = rows.groupBy(F.lower(F.trim("name")).alias("k")).agg(F.array_sort(F.collect_list("name")).alias("names")).where(F.size("names") > 1)
    mapping = groups.select(F.col("names")[0].alias("canonical"), F.expr("slice(names, 2, size(names))").alias("aliases"))
    return extraction.resolve(rows, mapping).select("name", "type", F.array_join("aliases", "|").alias("aliases"))


def _scores(prompts: list[str]) -> list[str]:
    """Scores by place, worst first, the third document twice; the documents are numbered in the prompt."""
    out = []
    for p in prompts:
        n = max((int(k) for k in re.findall(r"^\[(\d+)\] ", p, re.MULTILINE)), default=-1) + 1
        rows = [{"doc_index": k, "score": k * 7 % 10} for k in range(n)] + ([{"doc_index": 2, "score": 9.5}] if n > 2 else [])
        out.append("```json\n" + json.dumps(rows) + "\n```")
    return out


@query(
    "rerank_by_model",
    _SQL_RANKED + """, s AS (SELECT project, doc_id, doc_index, CASE WHEN doc_index = 2 THEN 9.5 ELSE doc_index * 7 % 10 END::DOUBLE AS score FROM d), p AS (SELECT *, (row_number() OVER (PARTITION BY project ORDER BY score DESC, doc_index))::INT AS position FROM s)
SELECT project, doc_id, score, position FROM p WHERE position <= 3""",
)
def rerank_by_model(spark, folder):
    """The three best documents of each project by a model's scores."""
    docs = _ranked_docs(spark, folder)[0].withColumn("content", F.concat(F.lit("doc "), "doc_id")).withColumn("query", F.col("project"))
    return rerank.ModelReranker(_scores, top_k=3).rerank(docs, "query", "project").select("project", "doc_id", "score", "position")


_ANSWER = "Answer by the context.\n\nContext:\n{context}\n\nQuestion: {query}"
_SQL_RUN = f"""q AS (SELECT id AS qid, summary AS query, {_sql_letters("summary")} AS v FROM (SELECT DISTINCT ON (id) id, summary FROM graph_communities) WHERE summary IS NOT NULL), c AS (SELECT * FROM ({_SQL_CHUNKS}) WHERE len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: NOT isfinite(x)), true)),
d AS (SELECT qid, query, c.id, content, coalesce(source, 'unknown') AS source, row_number() OVER (PARTITION BY qid ORDER BY round(list_distance(embedding::DOUBLE[], v), 9), c.id) AS r FROM q, c),
x AS (SELECT qid, query, string_agg(content, chr(10) ORDER BY r) AS context, string_agg(source, '|' ORDER BY r) AS sources FROM d WHERE r <= 3 GROUP BY qid, query),
a AS (SELECT *, CASE WHEN length({_sql_rendered(_ANSWER, context="context", query="query")}) % 2 = 1 THEN 'YES' ELSE 'NO' END AS response FROM x),
h AS (SELECT *, length({_sql_rendered(generation.HALLUCINATION_PROMPT, query="query", context="context", response="response")}) % 2 = 0 AS hallucination, length({_sql_rendered(generation.TRIAD_PROMPT, query="query", context="context", response="response")}) AS size FROM a)
"""


def _run(spark, folder):
    """Every summary as a query: vector, nearest chunks, context, prompt and answer."""
    rows = schemas.copies_once(_t(spark, folder, "graph_communities")).where("summary IS NOT NULL").select(F.col("id").alias("qid"), F.col("summary").alias("query"))
    rows = generation.embed_query(generation.new(rows), letters)
    known = _chunks(spark, folder)

    def near(queries: DataFrame) -> DataFrame:
        found = search.semantic_batch(known, queries.select("qid", F.col("query_embedding").alias("embedding")), 3)
        return found.join(known.select("id", "content", "source"), "id").select("qid", F.col("rank").alias("position"), F.col("id").cast("string").alias("id"), "content", (1 / (1 + F.col("distance"))).alias("score"), "source", F.create_map().cast("map<string,string>").alias("metadata"))

    rows = generation.retrieve(rows, "semantic", near)
    rows = generation.build_prompt(generation.build_context_sources(generation.build_context(rows, "semantic"), "semantic"), _ANSWER)
    return generation.generate_response(rows, yes_or_no)


@query("generation_run", "WITH " + _SQL_RUN + "SELECT qid, response, false AS halted, hallucination::VARCHAR AS hallucination, sources FROM h")
def generation_run(spark, folder):
    done = generation.detect_hallucination(_run(spark, folder), yes_or_no)
    return done.select("qid", "response", "halted", F.col("evaluations")["hallucination"].alias("hallucination"), F.array_join("context_sources", "|").alias("sources"))


def _triad(prompts: list[str]) -> list[str]:
    return [json.dumps({"context_relevance_reasoning": "r", "context_relevance_score": len(p) % 5 + 1, "groundedness_score": len(p) % 3 + 1, "answer_relevance_score": 5}) for p in prompts]


@query("evaluation_triad", "WITH " + _SQL_RUN + "SELECT qid, 'r' AS context_relevance_reasoning, (size % 5 + 1)::INT AS context_relevance_score, (size % 3 + 1)::INT AS groundedness_score, 5::INT AS answer_relevance_score FROM h")
def evaluation_triad(spark, folder):
    """Three scores of every answer; absent reasons are null."""
    scored = generation.triad_scores(generation.evaluate_triad(_run(spark, folder), _triad))
    return scored.select("qid", "context_relevance_reasoning", "context_relevance_score", "groundedness_score", "answer_relevance_score")
