"""Queries of the engine's operators over the test tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagebrook import models, schemas
from sagebrook.functions import chunkers
from sagebrook.functions import vector as V
from sagebrook.functions.text import graphemes, line_slice, token_estimate
from sagebrook.operators import chunking, community, fusion, generation, graph, rerank, retrievers, search, triples
from sagebrook.operators.positions import positions
from sagebrook.plans import agent, routing

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return keep


def _t(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    return schemas.copies_once(_t(spark, folder, "rag_chunks").select("id", "content", "source", "embedding"))


def _raw(spark: SparkSession, folder: str, table: str = "rag_chunks") -> DataFrame:
    """All rows, copies too, for operators that count copies once themselves."""
    return _t(spark, folder, table).drop("metadata", "properties", "inserted_at", "updated_at")


def _entities(spark: SparkSession, folder: str) -> DataFrame:
    return schemas.copies_once(_t(spark, folder, "graph_entities").select("id", "type", "name", "embedding", "source_chunk_ids"))


def _edges(spark: SparkSession, folder: str) -> DataFrame:
    return schemas.copies_once(_t(spark, folder, "graph_edges").select("id", "from_id", "to_id", "type", "weight"))


def _vector(spark: SparkSession, folder: str) -> list[float]:
    row = _t(spark, folder, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else [0.0] * 64


TEXT = "the limit and the list"
_SQL_CHUNKS = "SELECT DISTINCT ON (id) id, content, source, embedding FROM rag_chunks"
_SQL_ENTITIES = "SELECT DISTINCT ON (id) id, type, name, embedding, source_chunk_ids FROM graph_entities"
_SQL_EDGES = "SELECT DISTINCT ON (id) id, from_id, to_id, type, weight FROM graph_edges"
_SQL_Q = "SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0"
_SQL_DISTANCE = "CASE WHEN len(embedding) = 64 AND NOT list_contains(list_transform(embedding, lambda x: isnan(x)), true) THEN list_distance(embedding::DOUBLE[], v) END"
_SQL_TERMS = r"list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


# --- search ---


@query(
    "semantic_topk",
    f"""WITH q AS ({_SQL_Q}), c AS ({_SQL_CHUNKS}), d AS (SELECT id, {_SQL_DISTANCE} AS d FROM c, q)
SELECT id, round(d, 6) AS distance, round(greatest(0, 1 - d), 6) AS score_clamped, round(1 / (1 + d), 6) AS score_decay FROM d WHERE d IS NOT NULL ORDER BY d, id LIMIT 10""",
)
def semantic_topk(spark, folder):
    top = search.semantic(_raw(spark, folder).select("id", "embedding"), _vector(spark, folder), 10, copies=True)
    return top.select("id", F.round("distance", 6).alias("distance"), F.round("score", 6).alias("score_clamped"), F.round(V.decaying_score(F.col("distance")), 6).alias("score_decay"))


@query(
    "entity_knn_by_type",
    f"""WITH q AS ({_SQL_Q}), e AS ({_SQL_ENTITIES}), d AS (SELECT id, type, name, {_SQL_DISTANCE} AS d FROM e, q WHERE type = 'technology')
SELECT id, type, name, round(d, 6) AS distance FROM d WHERE d IS NOT NULL ORDER BY d, id LIMIT 10""",
)
def entity_knn_by_type(spark, folder):
    return graph.entities_by_vector(_raw(spark, folder, "graph_entities"), _vector(spark, folder), 10, "technology", copies=True).select("id", "type", "name", F.round("distance", 6).alias("distance"))


@query(
    "knn_batch",
    """WITH d AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
r AS (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM d) SELECT qid, id, rank::INT AS rank, round(d, 5) AS distance FROM r WHERE rank <= 10""",
)
def knn_batch(spark, folder):
    rows = _t(spark, folder, "embeddings")
    found = search.semantic_batch(rows, rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), 10, key="vec_id")
    return found.select("qid", "id", "rank", F.round("distance", 5).alias("distance"))


@query(
    "cosine_to_query",
    f"""WITH q AS ({_SQL_Q}) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS similarity FROM embeddings, q""",
)
def cosine_to_query(spark, folder):
    return _t(spark, folder, "embeddings").select("vec_id", F.round(V.cosine(F.col("embedding"), V.literal(_vector(spark, folder))), 6).alias("similarity"))


@query(
    "fulltext_and",
    f"""WITH c AS ({_SQL_CHUNKS}), t AS (SELECT id, {_SQL_TERMS} AS t FROM c)
SELECT id, round(len(list_filter(t, lambda x: list_contains(['the', 'limit', 'and', 'list'], x)))::DOUBLE / len(t), 6) AS rank FROM t WHERE list_has_all(t, ['the', 'limit', 'and', 'list'])""",
)
def fulltext_and(spark, folder):
    return search.text_matches(_raw(spark, folder).select("id", "content"), TEXT, copies_of="id").select("id", F.round("rank", 6).alias("rank"))


@query(
    "fulltext_topk",
    f"""WITH c AS ({_SQL_CHUNKS}), t AS (SELECT id, source, {_SQL_TERMS} AS t FROM c)
SELECT id, source, round(len(list_filter(t, lambda x: list_contains(['the', 'and'], x)))::DOUBLE / len(t), 6) AS score FROM t WHERE list_has_all(t, ['the', 'and'])
ORDER BY len(list_filter(t, lambda x: list_contains(['the', 'and'], x)))::DOUBLE / len(t) DESC, id LIMIT 10""",
)
def fulltext_topk(spark, folder):
    return search.fulltext(_raw(spark, folder).select("id", "content", "source"), "the AND and", 10, copies_of="id").select("id", "source", F.round("score", 6).alias("score"))


@query(
    "term_index",
    f"""WITH c AS ({_SQL_CHUNKS}), t AS (SELECT id, unnest({_SQL_TERMS}) AS term FROM c), u AS (SELECT term, id, count(*) AS tf FROM t GROUP BY term, id)
SELECT term, count(*) AS documents, sum(tf)::BIGINT AS occurrences FROM u GROUP BY term""",
)
def term_index(spark, folder):
    index = search.inverted_index(_chunks(spark, folder))
    return index.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences"))


@query(
    "bm25_topk",
    f"""WITH c AS ({_SQL_CHUNKS}), l AS (SELECT id, {_SQL_TERMS} AS t FROM c), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM l WHERE len(t) > 0),
u AS (SELECT term, id, length, count(*) AS tf FROM (SELECT id, len(t) AS length, unnest(t) AS term FROM l) WHERE term IN ('session', 'limit') GROUP BY term, id, length),
w AS (SELECT *, ln(1 + (n - count(*) OVER (PARTITION BY term) + 0.5) / (count(*) OVER (PARTITION BY term) + 0.5)) AS idf FROM u, s)
SELECT id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score FROM w GROUP BY id
ORDER BY round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 9) DESC, id LIMIT 10""",
)
def bm25_topk(spark, folder):
    chunks = _chunks(spark, folder).select("id", "content")
    return search.bm25(search.inverted_index(chunks), search.index_stats(chunks), "session limit").select("id", F.round("score", 6).alias("score"))


_SQL_HYBRID = f"""WITH q AS ({_SQL_Q}), c AS ({_SQL_CHUNKS}), d AS (SELECT id, {_SQL_DISTANCE} AS d FROM c, q),
s AS (SELECT id, row_number() OVER (ORDER BY d, id) AS r FROM d WHERE d IS NOT NULL ORDER BY d, id LIMIT 10),
t AS (SELECT id, {_SQL_TERMS} AS t FROM c),
m AS (SELECT id, len(list_filter(t, lambda x: list_contains(['the', 'limit', 'and', 'list'], x)))::DOUBLE / len(t) AS rank FROM t WHERE list_has_all(t, ['the', 'limit', 'and', 'list'])),
f AS (SELECT id, row_number() OVER (ORDER BY rank DESC, id) AS r FROM m ORDER BY rank DESC, id LIMIT 10)
"""


@query("hybrid_rrf", _SQL_HYBRID + "SELECT id, round(sum(1.0 / (60 + r)), 9) AS score FROM (SELECT * FROM s UNION ALL SELECT * FROM f) GROUP BY id ORDER BY sum(1.0 / (60 + r)) DESC, id LIMIT 10")
def hybrid_rrf(spark, folder):
    found = retrievers.Hybrid(_raw(spark, folder), copies=True).retrieve(retrievers.Query(TEXT, _vector(spark, folder)))
    return found.select("id", F.round("score", 9).alias("score"))


def _lists(spark, folder):
    base = _raw(spark, folder)
    near = search.semantic(base.select("id", "embedding"), _vector(spark, folder), copies=True).select("id", F.row_number().over(Window.orderBy("distance", "id")).alias("position"))
    match = search.fulltext(base.select("id", "content"), TEXT, copies_of="id").select("id", F.row_number().over(Window.orderBy(F.desc("rank"), "id")).alias("position"))
    return near, match


@query(
    "weighted_rrf",
    _SQL_HYBRID
    + """, a AS (SELECT id, 1.0 * (SELECT count(*) FROM s) / (60 + r - 1) / (2 / 60.0) AS p FROM s UNION ALL SELECT id, 2.0 * (SELECT count(*) FROM f) / (60 + r - 1) / (2 / 60.0) FROM f)
SELECT id, round(sum(p), 6) AS score FROM a GROUP BY id""",
)
def weighted_rrf(spark, folder):
    near, match = _lists(spark, folder)
    return fusion.weighted_ranks({"near": (near, 1.0), "match": (match, 2.0)}).select("id", F.round("score", 6).alias("score"))


@query(
    "local_global_rrf",
    _SQL_HYBRID + """SELECT id, round(sum(p), 9) AS score FROM (SELECT id, 0.8 / (60 + r - 1) AS p FROM s UNION ALL SELECT id, 0.2 / (60 + r - 1) FROM f) GROUP BY id""",
)
def local_global_rrf(spark, folder):
    near, match = _lists(spark, folder)
    return fusion.local_global_ranks(near, match, 0.8, 0.2).select("id", F.round("score", 9).alias("score"))


@query("concat_results", _SQL_HYBRID + "SELECT 0 AS list, id, r::INT AS position FROM s UNION ALL SELECT 1, id, r::INT FROM f")
def concat_results(spark, folder):
    return fusion.concatenated(list(_lists(spark, folder))).select("list", "id", "position")


@query(
    "dedup_keep_first",
    """SELECT doc_id, text, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1""",
)
def dedup_keep_first(spark, folder):
    return fusion.first_of_each(_t(spark, folder, "documents").select("doc_id", "text", "source"), ["text"], ["doc_id"])


# --- chunking ---

_SQL_SPACE = r"[ \t\n\r\f\v]"


@query(
    "chunk_sentences",
    rf"""WITH l AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(text, '^{_SQL_SPACE}+', ''), '([.!?]){_SQL_SPACE}+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '{_SQL_SPACE}+', '', 'g') <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS index, unnest(l) AS content FROM l""",
)
def chunk_sentences(spark, folder):
    whole = chunkers.Sentence(max_chars=1 << 30)
    return chunking.chunk(_t(spark, folder, "documents"), whole, "text", ["doc_id"]).select("doc_id", "index", "content")


@query("chunk_sentences_builtin", ORACLE["chunk_sentences"])
def chunk_sentences_builtin(spark, folder):
    docs = _t(spark, folder, "documents").select("doc_id", F.regexp_replace("text", r"^[ \t\n\r\f\x0b]+", "").alias("text"))
    return chunking.sentence_chunks(docs, "text", ["doc_id"]).select("doc_id", F.col("index").cast("int").alias("index"), "content")


@query(
    "chunk_paragraphs",
    rf"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '(?:\r?\n{_SQL_SPACE}*){{2,}}'), lambda x: regexp_replace(x, '^{_SQL_SPACE}+|{_SQL_SPACE}+$', '', 'g')), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)
SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS index, unnest(l) AS content FROM l""",
)
def chunk_paragraphs(spark, folder):
    return chunking.paragraph_chunks(_t(spark, folder, "documents"), "text", ["doc_id"]).select("doc_id", F.col("index").cast("int").alias("index"), "content")


def _chunked(chunker):
    return lambda spark, folder: chunking.chunk(_t(spark, folder, "documents"), chunker, "text", ["doc_id"]).withColumn("metadata", F.to_json("metadata"))


def _sentence_vectors(texts: list[str]) -> list[list[float]]:
    return models.HashProvider(dim=32).embed(texts)


CHUNKERS = {
    "character": chunkers.Character(), "sentence_packed": chunkers.Sentence(500, 200), "paragraph_packed": chunkers.Paragraph(500, 200), "recursive": chunkers.Recursive(),
    "semantic": chunkers.Semantic(_sentence_vectors, 0.2), "format_aware": chunkers.FormatAware("markdown", 800, 100),
}
for _name, _chunker in CHUNKERS.items():
    QUERIES[f"chunk_{_name}"] = _chunked(_chunker)


#: White space of any script, which chunkers may drop at the ends of chunks.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_SQL_INK = f"translate(text, {' || '.join(f'chr({ord(c)})' for c in SPACES)}, '')"


@query(
    "chunk_coverage",
    "WITH d AS (SELECT doc_id, " + _SQL_INK + " AS ink FROM documents WHERE text IS NOT NULL) SELECT chunker, doc_id, md5(ink) AS ink, length(ink) AS characters FROM d, (VALUES " + ", ".join(f"('{n}')" for n in CHUNKERS) + ") v(chunker) WHERE ink <> ''",
)
def chunk_coverage(spark, folder):
    """What the chunks of each text hold, overlaps once and without white space: the whole text, in order."""
    docs = _t(spark, folder, "documents").select("doc_id", "text").where("text IS NOT NULL")
    out = None
    order = Window.partitionBy("doc_id").orderBy("index")
    for name, chunker in CHUNKERS.items():
        parts = chunking.chunk(docs, chunker, "text", ["doc_id"]).select("doc_id", "index", "content", "start_byte", "end_byte")
        seen = F.coalesce(F.max("end_byte").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        new = parts.withColumn("again", F.greatest(seen - F.col("start_byte"), F.lit(0))).withColumn("new", F.decode(F.expr("substring(encode(content, 'UTF-8'), again + 1)"), "UTF-8"))
        whole = new.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "new"))).alias("parts")).select("doc_id", F.translate(F.array_join("parts.new", ""), SPACES, "").alias("ink"))
        one = whole.where("ink <> ''").select(F.lit(name).alias("chunker"), "doc_id", F.md5(F.col("ink")).alias("ink"), F.length("ink").cast("long").alias("characters"))
        out = one if out is None else out.unionByName(one)
    return out


@query("chunk_validity", "SELECT * FROM (VALUES " + ", ".join(f"('{n}', true)" for n in ("character", "paragraph_packed", "recursive", "sentence_packed", "semantic", "format_aware")) + ") v(chunker, valid)")
def chunk_validity(spark, folder):
    docs = _t(spark, folder, "documents").select("doc_id", "text")
    out = None
    for name, chunker in CHUNKERS.items():
        parts = chunking.chunk(docs.withColumn("whole", F.col("text")), chunker, "text", ["whole"])
        one = parts.agg(F.coalesce(F.bool_and(chunking.valid_chunk(F.col("whole"), F.col("content"), F.col("start_byte"), F.col("end_byte"))), F.lit(True)).alias("valid")).select(F.lit(name).alias("chunker"), "valid")
        out = one if out is None else out.unionByName(one)
    return out


@query("text_lengths", "SELECT doc_id, length(text) AS characters, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL")
def text_lengths(spark, folder):
    docs = _t(spark, folder, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", F.length("text").cast("long").alias("characters"), F.octet_length("text").cast("long").alias("bytes"))


@query("text_graphemes")
def text_graphemes(spark, folder):
    """No SQL: the engines' Unicode versions cut some emoji differently."""
    return _t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", graphemes(F.col("text")).cast("long").alias("graphemes"))


@query("line_slices", r"SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS lines FROM documents WHERE text IS NOT NULL")
def line_slices(spark, folder):
    return _t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", line_slice(F.col("text"), 2, 4).alias("lines"))


# --- graph ---


def _neighbours_sql(direction: str) -> str:
    out = "SELECT from_id AS node, to_id AS id, type AS edge_type, weight FROM e"
    back = "SELECT to_id, from_id, type, weight FROM e"
    steps = {"out": out, "in": back.replace("to_id, from_id, type", "to_id AS node, from_id AS id, type AS edge_type"), "both": f"{out} UNION ALL {back}"}[direction]
    return f"""WITH e AS ({_SQL_EDGES}), n AS ({_SQL_ENTITIES}), s AS ({steps}),
r AS (SELECT s.node, s.id, n.type, n.name, s.edge_type, s.weight, row_number() OVER (PARTITION BY node ORDER BY s.id, edge_type, weight NULLS FIRST) AS r FROM s JOIN n ON n.id = s.id WHERE node IS NOT NULL)
SELECT node, id, type, name, edge_type, weight FROM r WHERE r <= 10"""


def _neighbours(direction: str):
    def run(spark, folder):
        known = _edges(spark, folder)
        every = known.select(F.col("from_id").alias("id")).union(known.select("to_id")).where("id IS NOT NULL").distinct()
        return graph.neighbours(_entities(spark, folder), known, every, direction)

    return run


for _direction in ("out", "in", "both"):
    query(f"neighbours_{_direction}", _neighbours_sql(_direction))(_neighbours(_direction))


@query(
    "bfs_paths",
    f"""WITH RECURSIVE e AS ({_SQL_EDGES}), n AS (SELECT DISTINCT id FROM graph_entities),
g AS (SELECT id AS start, id, 0 AS depth, [id] AS path FROM n UNION ALL SELECT start, to_id, depth + 1, list_append(path, to_id) FROM g JOIN e ON e.from_id = g.id WHERE depth < 2 AND to_id IS NOT NULL AND NOT list_contains(path, to_id))
SELECT start, id, depth, array_to_string(path, '>') AS path FROM g""",
)
def bfs_paths(spark, folder):
    edges = _edges(spark, folder).where("to_id IS NOT NULL")
    found = graph.paths(edges, _entities(spark, folder).select("id"), 2)
    return found.select("start", "id", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(
    "bfs_nodes",
    f"""WITH RECURSIVE e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM ({_SQL_EDGES}) WHERE from_id IS NOT NULL AND to_id IS NOT NULL),
n AS (SELECT DISTINCT id FROM graph_entities),
g AS (SELECT id AS start, id, 0 AS depth FROM n UNION SELECT start, b, depth + 1 FROM g JOIN e ON e.a = g.id WHERE depth < 3)
SELECT start, id, min(depth)::INT AS depth FROM g GROUP BY start, id""",
)
def bfs_nodes(spark, folder):
    return graph.traverse(_edges(spark, folder), _entities(spark, folder).select("id"), 3)


@query(
    "community_members",
    f"""WITH e AS ({_SQL_ENTITIES}), m AS (SELECT DISTINCT id AS community_id, unnest(entity_ids) AS id FROM graph_communities)
SELECT community_id, m.id, type, name FROM m JOIN e ON e.id = m.id""",
)
def community_members(spark, folder):
    return graph.community_members(_t(spark, folder, "graph_communities"), _entities(spark, folder))


@query(
    "community_relations",
    f"""WITH e AS ({_SQL_EDGES}), n AS ({_SQL_ENTITIES}), m AS (SELECT DISTINCT id AS community_id, unnest(entity_ids) AS id FROM graph_communities), k AS (SELECT community_id, m.id FROM m JOIN n ON n.id = m.id)
SELECT a.community_id, e.id, e.from_id, e.to_id, e.type, e.weight FROM e JOIN k a ON a.id = e.from_id JOIN k b ON b.id = e.to_id AND b.community_id = a.community_id""",
)
def community_relations(spark, folder):
    members = graph.community_members(_t(spark, folder, "graph_communities"), _entities(spark, folder))
    return graph.relations_within(members, _edges(spark, folder))


def _lpa_sql(rounds: int) -> str:
    sql = f"""WITH n AS (SELECT DISTINCT id FROM graph_entities), e AS (SELECT from_id AS a, to_id AS b FROM ({_SQL_EDGES}) WHERE from_id IN (SELECT id FROM n) AND to_id IN (SELECT id FROM n)),
l AS (SELECT a AS id, b AS other FROM e UNION ALL SELECT b, a FROM e), r0 AS (SELECT DISTINCT id, id AS label FROM l)"""
    for k in range(rounds):
        sql += f""", v{k} AS (SELECT l.id, r.label FROM l JOIN r{k} r ON r.id = l.other UNION ALL SELECT id, label FROM r{k}), c{k} AS (SELECT id, label, count(*) AS n FROM v{k} GROUP BY id, label),
r{k + 1} AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS p FROM c{k}) WHERE p = 1)"""
    return sql + f" SELECT n.id, coalesce(r.label, n.id) AS label FROM n LEFT JOIN r{rounds} r ON r.id = n.id"


@query("label_propagation_3", _lpa_sql(3))
def label_propagation_3(spark, folder):
    return community.label_propagation(_entities(spark, folder), _edges(spark, folder), 3)


@query(
    "chunks_of_entities",
    f"""WITH c AS ({_SQL_CHUNKS}), e AS ({_SQL_ENTITIES}), x AS (SELECT DISTINCT unnest(source_chunk_ids) AS id FROM e WHERE type = 'person') SELECT c.id, c.source, 0 AS depth FROM c JOIN x ON x.id = c.id""",
)
def chunks_of_entities(spark, folder):
    return graph.chunks_of_entities(_entities(spark, folder).where("type = 'person'"), _chunks(spark, folder)).select("id", "source", "depth")


@query(
    "entities_of_chunks",
    f"""WITH e AS ({_SQL_ENTITIES}), x AS (SELECT id, name, unnest(source_chunk_ids) AS c FROM e) SELECT DISTINCT id, name FROM x WHERE c IN (SELECT id FROM rag_chunks)""",
)
def entities_of_chunks(spark, folder):
    return graph.entities_of_chunks(_entities(spark, folder), _chunks(spark, folder).select("id")).select("id", "name")


@query(
    "local_graph_search",
    f"""WITH RECURSIVE q AS ({_SQL_Q}), n AS ({_SQL_ENTITIES}), c AS ({_SQL_CHUNKS}), d AS (SELECT id, {_SQL_DISTANCE} AS d FROM n, q),
s AS (SELECT id FROM d WHERE d IS NOT NULL ORDER BY d, id LIMIT 10), e AS (SELECT DISTINCT from_id AS a, to_id AS b FROM ({_SQL_EDGES}) WHERE from_id IS NOT NULL AND to_id IS NOT NULL),
g AS (SELECT id, 0 AS depth FROM s UNION SELECT b, depth + 1 FROM g JOIN e ON e.a = g.id WHERE depth < 2), m AS (SELECT id, min(depth) AS depth FROM g GROUP BY id),
x AS (SELECT unnest(n.source_chunk_ids) AS id, m.depth FROM n JOIN m ON m.id = n.id), y AS (SELECT id, min(depth) AS depth FROM x GROUP BY id)
SELECT c.id::VARCHAR AS id, c.content, round(1.0 / (1 + y.depth), 6) AS score FROM c JOIN y ON y.id = c.id ORDER BY y.depth, c.id LIMIT 10""",
)
def local_graph_search(spark, folder):
    meta = F.lit(None).cast("map<string,string>").alias("metadata")
    found = retrievers.Graph(_entities(spark, folder), _edges(spark, folder), _chunks(spark, folder).select("*", meta)).retrieve(retrievers.Query(embedding=_vector(spark, folder)))
    return found.select("id", "content", F.round("score", 6).alias("score"))


# --- triples ---


def _store(spark, folder):
    entities = _t(spark, folder, "graph_entities").select("id", "type", "name", "properties", "embedding", "source_chunk_ids")
    edges = _t(spark, folder, "graph_edges").select("id", "from_id", "to_id", "type", "weight", "properties")
    return triples.store([triples.entity_triples(entities), triples.edge_triples(edges), triples.community_triples(_t(spark, folder, "graph_communities"))])


_SQL_STORE = """WITH t AS (
SELECT 'urn:entity:' || id AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, 'urn:type:' || type AS o FROM graph_entities
UNION SELECT 'urn:entity:' || id, 'urn:prop:name', name FROM graph_entities
UNION SELECT 'urn:entity:' || id, 'urn:meta:has_embedding', 'true' FROM graph_entities WHERE embedding IS NOT NULL
UNION SELECT 'urn:entity:' || id, 'urn:meta:source_chunk', c::VARCHAR FROM (SELECT id, unnest(source_chunk_ids) AS c FROM graph_entities)
UNION SELECT 'urn:entity:' || id, 'urn:prop:' || e.key, e.value FROM (SELECT id, unnest(map_entries(properties)) AS e FROM graph_entities)
UNION SELECT 'urn:entity:' || from_id, 'urn:rel:' || type, 'urn:entity:' || to_id FROM graph_edges
UNION SELECT 'urn:community:' || id, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'urn:type:community' FROM graph_communities
UNION SELECT 'urn:community:' || id, 'urn:prop:level', level::VARCHAR FROM graph_communities
UNION SELECT 'urn:community:' || id, 'urn:prop:summary', summary FROM graph_communities
UNION SELECT 'urn:community:' || id, 'urn:meta:has_member', 'urn:entity:' || m FROM (SELECT id, unnest(entity_ids) AS m FROM graph_communities)
UNION SELECT 'urn:entity:' || m, 'urn:meta:member_of', 'urn:community:' || id FROM (SELECT id, unnest(entity_ids) AS m FROM graph_communities)
UNION SELECT 'urn:edge:' || id, x.p, x.o FROM (SELECT id, unnest([{'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'o': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#Statement'},
  {'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#subject', 'o': 'urn:entity:' || from_id}, {'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#predicate', 'o': 'urn:rel:' || type},
  {'p': 'http://www.w3.org/1999/02/22-rdf-syntax-ns#object', 'o': 'urn:entity:' || to_id}, {'p': 'urn:prop:weight', 'o': weight::VARCHAR}]) AS x FROM graph_edges WHERE (weight IS NOT NULL AND weight <> 1) OR coalesce(cardinality(properties), 0) > 0)
UNION SELECT 'urn:edge:' || id, 'urn:prop:' || e.key, e.value FROM (SELECT id, unnest(map_entries(properties)) AS e FROM graph_edges))
"""


@query("triples", _SQL_STORE + "SELECT s, p, o FROM t WHERE s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
def all_triples(spark, folder):
    return _store(spark, folder).where("s IS NOT NULL AND p IS NOT NULL").select("s", "p", "o")


@query("triples_by_predicate", _SQL_STORE + "SELECT s, o FROM t WHERE p = 'urn:rel:part_of' AND s IS NOT NULL AND o IS NOT NULL")
def triples_by_predicate(spark, folder):
    return triples.match(_store(spark, folder), p="urn:rel:part_of").where("s IS NOT NULL").select("s", "o")


@query(
    "entities_from_triples",
    """SELECT id, any_value(type) AS type, any_value(name) AS name, coalesce(list_sort(list_distinct(list(c) FILTER (c IS NOT NULL))), []) AS source_chunk_ids
FROM (SELECT id, type, name, c FROM graph_entities LEFT JOIN LATERAL (SELECT unnest(source_chunk_ids) AS c) ON true) GROUP BY id""",
)
def entities_from_triples(spark, folder):
    return triples.entities_from(triples.store([triples.entity_triples(_t(spark, folder, "graph_entities"))])).select("id", "type", "name", "source_chunk_ids")


# --- validation and stores ---


@query(
    "edge_problems",
    f"""WITH e AS ({_SQL_EDGES}), p AS (SELECT id, list_filter([CASE WHEN from_id IS NULL THEN 'from_id' END, CASE WHEN to_id IS NULL THEN 'to_id' END, CASE WHEN type IS NULL OR trim(type) = '' THEN 'type' END,
CASE WHEN weight < 0 OR weight > 1 THEN 'weight' END, CASE WHEN from_id = to_id THEN 'self_loop' END], lambda x: x IS NOT NULL) AS problems FROM e) SELECT id, array_to_string(problems, ',') AS problems FROM p WHERE len(problems) > 0""",
)
def edge_problems(spark, folder):
    return _edges(spark, folder).withColumn("problems", schemas.edge_problems()).where(F.size("problems") > 0).select("id", F.array_join("problems", ",").alias("problems"))


@query(
    "entity_problems",
    f"""WITH e AS ({_SQL_ENTITIES}), p AS (SELECT id, list_filter([CASE WHEN type IS NULL OR trim(type) = '' OR lower(type) = 'nil' THEN 'type' END, CASE WHEN name IS NULL OR trim(name) = '' THEN 'name' END], lambda x: x IS NOT NULL) AS problems FROM e)
SELECT id, array_to_string(problems, ',') AS problems FROM p WHERE len(problems) > 0""",
)
def entity_problems(spark, folder):
    return _entities(spark, folder).withColumn("problems", schemas.entity_problems()).where(F.size("problems") > 0).select("id", F.array_join("problems", ",").alias("problems"))


@query("community_problems", "SELECT id FROM graph_communities WHERE NOT coalesce(level >= 0 AND len(entity_ids) > 0, false)")
def community_problems(spark, folder):
    return _t(spark, folder, "graph_communities").where(F.size(schemas.community_problems()) > 0).select("id")


@query("blank_chunks", f"WITH c AS ({_SQL_CHUNKS}) SELECT id FROM c WHERE content IS NULL OR regexp_replace(content, '[ \\t\\n\\v\\f\\r]', '', 'g') = ''")
def blank_chunks(spark, folder):
    return _chunks(spark, folder).where(F.size(schemas.chunk_problems()) > 0).select("id")


@query(
    "dangling_edges",
    f"""WITH e AS ({_SQL_EDGES}) SELECT id, 'from_id' AS missing FROM e WHERE from_id IS NULL OR from_id NOT IN (SELECT id FROM graph_entities)
UNION ALL SELECT id, 'to_id' FROM e WHERE to_id IS NULL OR to_id NOT IN (SELECT id FROM graph_entities)""",
)
def dangling_edges(spark, folder):
    return schemas.dangling_edges(_edges(spark, folder), _entities(spark, folder)).select("id", "missing")


@query(
    "store_after_deletes",
    f"""WITH c AS ({_SQL_CHUNKS}) SELECT id, source FROM c WHERE regexp_replace(content, '[ \\t\\n\\v\\f\\r]', '', 'g') <> '' AND id NOT IN (SELECT rec_id FROM deletion_log WHERE tab = 'rag_chunks')""",
)
def store_after_deletes(spark, folder):
    import uuid

    from sagebrook.sources.snapshots import ChunkStore
    from sagebrook.storage import shared_folder

    store = ChunkStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    store.insert(_chunks(spark, folder))
    store.delete(_t(spark, folder, "deletion_log").where("tab = 'rag_chunks'").select("rec_id"))
    return store.read().select("id", "source")


# --- reranking, extraction, generation ---


def _ranked_docs(spark, folder):
    docs = _t(spark, folder, "documents").where("project IS NOT NULL").withColumn("doc_index", F.row_number().over(Window.partitionBy("project").orderBy("doc_id")) - 1)
    labels = _t(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    scores = docs.join(labels, "doc_id").select("project", "doc_index", F.col("label").cast("double").alias("score"))
    return docs.select("project", "doc_id", "doc_index", F.lit(0.5).alias("score")), scores


_SQL_RANKED = """WITH d AS (SELECT project, doc_id, (row_number() OVER (PARTITION BY project ORDER BY doc_id) - 1)::INT AS doc_index FROM documents WHERE project IS NOT NULL),
n AS (SELECT project, doc_index, label::DOUBLE AS new FROM d JOIN embeddings ON vec_id = doc_id)
"""


@query(
    "rerank_apply",
    _SQL_RANKED
    + """SELECT project, doc_id, doc_index, score, position::INT AS position FROM (SELECT d.project, doc_id, d.doc_index, coalesce(new, 0.5) AS score, row_number() OVER (PARTITION BY d.project ORDER BY coalesce(new, 0.5) DESC, d.doc_index) AS position
FROM d LEFT JOIN n ON n.project = d.project AND n.doc_index = d.doc_index) WHERE position <= 3""",
)
def rerank_apply(spark, folder):
    docs, scores = _ranked_docs(spark, folder)
    return rerank.apply_scores(docs, scores, ["project"], 3)


@query(
    "rerank_normalised",
    _SQL_RANKED
    + """, m AS (SELECT project, doc_index, CASE WHEN max(new) OVER (PARTITION BY project) = min(new) OVER (PARTITION BY project) THEN 1.0 ELSE (new - min(new) OVER (PARTITION BY project)) / (max(new) OVER (PARTITION BY project) - min(new) OVER (PARTITION BY project)) END AS new FROM n)
SELECT d.project, doc_id, d.doc_index, round(coalesce(new, 0.5), 6) AS score, (row_number() OVER (PARTITION BY d.project ORDER BY coalesce(new, 0.5) DESC, d.doc_index))::INT AS position FROM d LEFT JOIN m ON m.project = d.project AND m.doc_index = d.doc_index""",
)
def rerank_normalised(spark, folder):
    docs, scores = _ranked_docs(spark, folder)
    return rerank.apply_scores(docs, scores, ["project"], None, True).withColumn("score", F.round("score", 6))


def _generation_lists(spark, folder):
    """Queries with two retrieved lists each: nearest by vector, and those in the order of their ids."""
    base = _t(spark, folder, "embeddings")
    rows = generation.new(base.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.lit("q").alias("query")))
    near = search.semantic_batch(base, base.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), 5, key="vec_id")
    result = lambda df, score: df.select("qid", F.col("rank").alias("position"), F.col("id").cast("string").alias("id"), F.lit("").alias("content"), score.alias("score"), F.lit(None).cast("string").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"))
    by_id = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    rows = generation.put_results(rows, "near", result(near, 1 / (1 + F.col("distance"))))
    return generation.put_results(rows, "by_id", result(by_id, F.lit(0.0)))


_SQL_LISTS = """WITH d AS (SELECT q.vec_id AS qid, e.vec_id AS id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS d FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0),
n AS (SELECT qid, id, r FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS r FROM d) WHERE r <= 5), b AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY id) AS r FROM n)
"""


@query(
    "generation_fusion",
    _SQL_LISTS
    + """, p AS (SELECT qid, id, 1.0 * 5 / (60 + r - 1) / (2 / 60.0) AS s FROM n UNION ALL SELECT qid, id, 2.0 * 5 / (60 + r - 1) / (2 / 60.0) FROM b)
SELECT qid, id::VARCHAR AS id, (row_number() OVER (PARTITION BY qid ORDER BY round(sum(s), 9) DESC, id::VARCHAR))::INT AS position FROM p GROUP BY qid, id""",
)
def generation_fusion(spark, folder):
    fused = generation.fuse(_generation_lists(spark, folder), {"near": 1.0, "by_id": 2.0}, "fused")
    return generation.results_of(fused, "fused").select("qid", "id", F.col("position").cast("int").alias("position"))


@query(
    "generation_concat",
    _SQL_LISTS
    + """, a AS (SELECT q.vec_id AS qid, e.vec_id AS id, e.vec_id - q.vec_id AS r FROM embeddings q JOIN embeddings e ON e.vec_id BETWEEN q.vec_id + 1 AND q.vec_id + 3 WHERE q.vec_id % 20 = 0),
o AS (SELECT qid, id, 0 AS l, r FROM n UNION ALL SELECT qid, id, 1, r FROM a), f AS (SELECT *, row_number() OVER (PARTITION BY qid, id ORDER BY l, r) AS first FROM o)
SELECT qid, id::VARCHAR AS id, (row_number() OVER (PARTITION BY qid ORDER BY l, r))::INT AS position FROM f WHERE first = 1""",
)
def generation_concat(spark, folder):
    """The nearest rows, then the three next ids, without repetitions."""
    rows = _generation_lists(spark, folder)
    ids = _t(spark, folder, "embeddings").select("vec_id")
    after = ids.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.posexplode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 3)).alias("place", "vec_id")).join(ids, "vec_id", "left_semi")
    found = after.select("qid", (F.col("place") + 1).alias("position"), F.col("vec_id").cast("string").alias("id"), F.lit("").alias("content"), F.lit(0.0).alias("score"), F.lit(None).cast("string").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"))
    both = generation.deduplicate(generation.concatenate(generation.put_results(rows, "after", found), ["near", "after"], "both"), "both", ["id"])
    return generation.results_of(both, "both").select("qid", "id", F.col("position").cast("int").alias("position"))


@query("zip_embeddings", "SELECT doc_id, source, vec_id FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS r FROM documents) JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r, count(*) OVER () AS n FROM embeddings) USING (r)")
def zip_embeddings(spark, folder):
    """As many documents as there are vectors, by position."""
    vectors = positions(_t(spark, folder, "embeddings"), ["vec_id"])
    docs = positions(_t(spark, folder, "documents").select("doc_id", "source"), ["doc_id"]).join(vectors.select("position"), "position", "left_semi")
    with_ids = vectors.select("position", F.struct("vec_id", "embedding").alias("embedding"))
    some = with_ids.join(docs.select("position"), "position", "left_semi")
    return models.with_vectors(docs, some).select("doc_id", "source", "embedding.vec_id")


# --- routing, conversations, registry ---


@query(
    "task_inference",
    "SELECT doc_id, CASE WHEN regexp_matches(lower(text), '" + "|".join(routing.ANALYSIS_WORDS) + "') THEN 'analysis' WHEN regexp_matches(lower(text), '" + "|".join(routing.CODE_WORDS) + "') THEN 'code_generation' ELSE 'general' END AS task FROM documents WHERE text IS NOT NULL",
)
def task_inference(spark, folder):
    return _t(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", routing.infer_task(F.col("text")).alias("task"))


@query(
    "circuit_breaker",
    """WITH c AS (SELECT event_id, ts, user_id % 3 AS provider, event_type = 'error' AS f FROM events), i AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE 1 END) OVER (PARTITION BY provider ORDER BY ts, event_id) AS g FROM c),
s AS (SELECT *, sum(CASE WHEN f THEN 1 ELSE 0 END) OVER (PARTITION BY provider, g ORDER BY ts, event_id) AS streak FROM i) SELECT event_id, provider, streak::BIGINT AS streak FROM s WHERE streak >= 3""",
)
def circuit_breaker(spark, folder):
    calls = _t(spark, folder, "events").select("event_id", "ts", F.pmod("user_id", F.lit(3)).alias("provider"), (F.col("event_type") == "error").alias("failed"))
    return routing.failure_streaks(calls).where("tripped").select("event_id", "provider", F.col("streak").cast("long").alias("streak"))


@query("provider_failures", "SELECT user_id % 3 AS provider, count(*) FILTER (event_type = 'error') AS failures, count(*) AS calls FROM events GROUP BY user_id % 3")
def provider_failures(spark, folder):
    return _t(spark, folder, "events").groupBy(F.pmod("user_id", F.lit(3)).alias("provider")).agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.count("*").alias("calls"))


@query("capability_lookup", "SELECT * FROM (VALUES ('gemini', 1000000)) v(provider, max_context)")
def capability_lookup(spark, folder):
    return models.capabilities(spark).where("embeddings").select("provider", "max_context")


def _log(spark, folder):
    return _t(spark, folder, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "user").otherwise("assistant").alias("role"), F.col("props").alias("content"))


@query("session_token_estimate", "SELECT user_id AS session, count(*) AS messages, (sum(length(props)) // 4)::BIGINT AS tokens FROM events GROUP BY user_id")
def session_token_estimate(spark, folder):
    return agent.token_estimates(_log(spark, folder))


@query("session_last_messages", "SELECT session, seq, content FROM (SELECT user_id AS session, event_id AS seq, props AS content, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 2")
def session_last_messages(spark, folder):
    return agent.last_messages(_log(spark, folder), 2).select("session", "seq", "content")


@query("session_transcript", "SELECT user_id AS session, string_agg(props, '' ORDER BY event_id) AS text FROM events WHERE event_type <> 'view' GROUP BY user_id")
def session_transcript(spark, folder):
    return agent.transcript(_log(spark, folder))


@query("corpus_tokens", "SELECT source, (sum(coalesce(length(text), 0)) // 4)::BIGINT AS tokens FROM documents GROUP BY source")
def corpus_tokens(spark, folder):
    return _t(spark, folder, "documents").groupBy("source").agg(token_estimate(F.col("text")).alias("tokens"))
