import pytest
from pyspark.sql import functions as F

from sagebrook.operators import community, graph, triples
from sagebrook.operators.components import connected_components
from sagebrook.operators.retrievers import Graph, Query


@pytest.fixture()
def tables(spark):
    entities = spark.createDataFrame([(1, "function", "a", [1]), (2, "function", "b", [1, 2]), (3, "function", "c", [3]), (4, "module", "d", None)], "id long, type string, name string, source_chunk_ids array<long>")
    edges = spark.createDataFrame([(1, 1, 2, "calls", 1.0), (2, 2, 3, "calls", 0.5), (3, 1, 4, "imports", None), (4, None, 2, "calls", 1.0), (5, 3, 3, "calls", 1.0)], "id long, from_id long, to_id long, type string, weight double")
    return entities, edges


def test_neighbours(tables):
    ids = lambda *a, **k: sorted(r.id for r in graph.neighbours(*tables, *a, **k).collect())
    assert ids([1], "out") == [2, 4]
    assert ids([2], "in") == [1]
    assert ids([1], "out", "calls") == [2]
    assert ids([1], "out", limit=1) == [2]
    assert ids([3], "both", limit=None) == [2, 3, 3]
    assert ids([3], "both", limit=None, unique=True) == [2, 3]
    assert ids([99]) == []


def test_traversal(spark, tables):
    start = spark.createDataFrame([(1,)], "id long")
    assert sorted(tuple(r) for r in graph.traverse(tables[1], start, 2).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 1)]
    assert [tuple(r) for r in graph.traverse(tables[1], start, 5, limit=2).orderBy("depth", "id").collect()] == [(1, 1, 0), (1, 2, 1)]
    listed = graph.paths(tables[1], start, 2).orderBy("path", "depth").collect()
    assert [r.path for r in listed] == [[1], [1, 2], [1, 2, 3], [1, 4]]
    visits = graph.depth_first(tables[1], start, 2).orderBy("visit").collect()
    assert [(r.id, r.depth) for r in visits] == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert graph.traverse(tables[1].where("false"), start, 2).count() == 1


def test_members_and_chunks(spark, tables):
    communities = spark.createDataFrame([(9, [1, 2, 2, None, 77]), (10, [])], "id long, entity_ids array<long>")
    members = graph.community_members(communities, tables[0])
    assert sorted((r.community_id, r.id) for r in members.collect()) == [(9, 1), (9, 2)]
    assert [r.id for r in graph.relations_within(members, tables[1]).collect()] == [1]
    chunks = spark.createDataFrame([(1, "x"), (2, "y"), (5, "z")], "id long, content string")
    depths = spark.createDataFrame([(1, 2), (2, 1)], "id long, depth int")
    assert sorted((r.id, r.depth) for r in graph.chunks_of_entities(tables[0], chunks, depths).collect()) == [(1, 1), (2, 1)]
    assert sorted(r.id for r in graph.entities_of_chunks(tables[0], chunks.select("id")).collect()) == [1, 2]


def test_graph_retriever(spark):
    entities = spark.createDataFrame([(1, "t", "a", [1.0, 0.0], [101]), (2, "t", "b", [0.0, 1.0], [102]), (3, "t", "c", [0.0, 1.0], [103])], "id long, type string, name string, embedding array<float>, source_chunk_ids array<long>")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "from_id long, to_id long").select("*", F.lit("r").alias("type"), F.lit(1.0).alias("weight"))
    chunks = spark.createDataFrame([(101, "x"), (102, "y"), (103, "z")], "id long, content string").select("*", F.lit("s").alias("source"), F.lit(None).cast("map<string,string>").alias("metadata"))
    communities = spark.createDataFrame([(1, 0, "sum", [1, 2], [1.0, 0.0])], "id long, level int, summary string, entity_ids array<long>, embedding array<float>")
    g = lambda mode: Graph(entities, edges, chunks, communities, lambda t: [[1.0, 0.0] for _ in t], mode, 2, 0.8, 0.2)
    local = g("local").retrieve(Query("q"), 1).collect()
    assert [(r.id, r.score, r.metadata["graph_depth"]) for r in local] == [("101", 1.0, "0")]
    scores = [r.score for r in g("local").local([1.0, 0.0], 3).collect()]
    assert scores == sorted(scores, reverse=True)
    assert [r.id for r in g("global").retrieve(Query("q")).collect()] == ["community_1"]
    both = [r.id for r in g("hybrid").retrieve(Query(embedding=[1.0, 0.0])).collect()]
    assert len(both) == len(set(both)) == 4
    with pytest.raises(ValueError):
        Graph(entities, edges, chunks).retrieve(Query("q"))


@pytest.mark.parametrize("mode", ["exact", "distributed"])
def test_label_propagation(spark, mode):
    def groups(nodes, edges):
        n = spark.createDataFrame([(x,) for x in nodes], "id long")
        e = spark.createDataFrame(edges or [(0, 0)], "from_id long, to_id long").where("from_id > 0")
        found = {}
        for r in community.label_propagation(n, e, mode=mode).collect():
            found.setdefault(r.label, set()).add(r.id)
        return sorted(map(sorted, found.values()))

    assert groups([1, 2, 3], [(1, 2), (2, 3), (3, 1)]) == [[1, 2, 3]]
    assert groups([1, 2, 3, 4], [(1, 2), (3, 4)]) == [[1, 2], [3, 4]]
    assert groups([1], []) == [[1]]
    assert groups([4, 5], [(4, 4)]) == [[4], [5]]


def test_hierarchy_and_summaries(spark):
    nodes = spark.createDataFrame([(n, "t", f"n{n}") for n in range(1, 7)], "id long, type string, name string")
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 4, 5), (5, 5, 6), (6, 6, 4), (7, 3, 6)], "id long, from_id long, to_id long").withColumn("type", F.lit("r")).withColumn("weight", F.lit(1.0))
    levels = community.hierarchy(nodes, edges, 2, mode="exact")
    assert [levels.where(f"level = {k}").select("label").distinct().count() for k in (0, 1)] == [2, 1]
    with pytest.raises(ValueError):
        community.hierarchy(nodes, edges, 0)
    done = community.detect_and_summarise(nodes, edges, nodes, lambda prompts: [str(p.count("- ")) for p in prompts], mode="exact").collect()
    assert sorted(r.summary for r in done) == ["6", "6"]
    assert community.communities(community.label_propagation(nodes, edges, mode="exact"), most=2).groupBy("id").count().first()["count"] == 2


def test_components(spark):
    links = spark.createDataFrame([(n, n + 1) for n in range(1, 40)] + [(100, 101), (7, 7), (200, 200), (None, 3)], "a long, b long")
    found = {r.id: r.component for r in connected_components(links).collect()}
    assert all(found[n] == 1 for n in range(1, 41)) and found[101] == 100 and found[200] == 200
    assert connected_components(links.where("false")).count() == 0


def test_triples(spark):
    entities = spark.createDataFrame([(1, "function", "foo", {"file": "lib/foo.x", "line": "42"}, None, [1, 2, 3])], "id long, type string, name string, properties map<string,string>, embedding array<float>, source_chunk_ids array<long>")
    edges = spark.createDataFrame([(1, 1, 2, "calls", 1.0, None), (2, 1, 3, "calls", 0.8, {})], "id long, from_id long, to_id long, type string, weight double, properties map<string,string>")
    t = triples.store([triples.entity_triples(entities), triples.edge_triples(edges)]).cache()
    assert triples.match(t, s="urn:entity:1", p="urn:rel:calls").count() == 2
    assert triples.match(t, s="urn:edge:1").count() == 0 and triples.match(t, s="urn:edge:2").count() == 5
    back = triples.entities_from(t).first()
    assert (back.id, back.type, back.name, back.properties, back.source_chunk_ids) == (1, "function", "foo", {"file": "lib/foo.x", "line": "42"}, [1, 2, 3])
    assert {r.o: r.o_type for r in t.where("p LIKE 'urn:prop:%'").collect()}["42"] == "integer"
    gone = triples.match(t, p="urn:prop:name")
    assert triples.match(triples.without(t, gone), p="urn:prop:name").count() == 0
    assert spark.range(1).select(triples.parse_uri(F.lit("urn:rel:calls")).alias("u")).first().u.asDict() == {"space": "rel", "name": "calls"}


def test_triple_indices(spark, tmp_path):
    t = spark.createDataFrame([("urn:entity:1", "urn:rel:x", "urn:entity:2", "uri"), ("urn:entity:2", "urn:rel:x", "urn:entity:3", "uri")], "s string, p string, o string, o_type string")
    triples.write_indices(t, str(tmp_path))
    assert triples.read_index(spark, str(tmp_path), o="urn:entity:3").count() == 1
    assert triples.read_index(spark, str(tmp_path), p="urn:rel:x").count() == 2
