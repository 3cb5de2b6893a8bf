import pytest

from sagebrook import models, schemas
from sagebrook.functions.chunkers import Sentence
from sagebrook.operators.chunking import chunk
from sagebrook.operators.positions import positions
from sagebrook.sources import files
from sagebrook.sources.snapshots import ChunkStore, GraphStore, from_chunks
from sagebrook.streaming.breaker import circuit_breaker, windowed_failures
from sagebrook.streaming.ingest import documents, ingest


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\nthree")
    loaded = files.load_files(spark, str(tmp_path))
    assert files.lines(loaded, 2, 3).first().document == "two\nthree"
    named = spark.createDataFrame([(str(tmp_path / "a.txt"),), (None,)], "source string")
    assert [r.document for r in files.load_sources(named).collect()] == ["one\ntwo\nthree", None]
    with pytest.raises(Exception, match="(?i)exist|found"):
        files.load_files(spark, str(tmp_path / "none")).collect()


def test_chunk_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/chunks")
    assert store.read().count() == 0
    df = spark.createDataFrame([("Hello", [1.0, 0.0]), ("World", [0.0, 1.0]), ("  ", None)], "content string, embedding array<float>")
    assert store.insert(df) == 2
    assert store.insert(spark.createDataFrame([(10, "Ten")], "id long, content string")) == 1
    assert store.insert(spark.createDataFrame([("Next",)], "content string")) == 1
    assert sorted(r.id for r in store.read().collect()) == [1, 2, 10, 11]
    assert [round(r.score, 3) for r in store.search([1.0, 0.0], 2).collect()] == [1.0, 0.414]
    assert store.get([2]).count() == 1 and store.get([]).count() == 0
    assert store.delete([2, 99]) == 1 and store.delete(spark.createDataFrame([(10,)], "x long")) == 1
    row = store.get([1]).first()
    assert row.metadata == {} and row.inserted_at is not None and store.read().count() == 2


def test_from_chunks(spark):
    pieces = chunk(spark.createDataFrame([("Hello.",)], "text string"), Sentence(), "text")
    assert from_chunks(pieces, "doc.txt").first().metadata == {"chunker": "sentence", "start_byte": "0", "end_byte": "6", "chunk_index": "0"}


def test_graph_store(spark, tmp_path):
    store = GraphStore(spark, f"file://{tmp_path}/graph")
    n, bad = store.create_nodes(spark.createDataFrame([("person", "Alice"), ("nil", "X"), ("person", " "), ("org", "Acme")], "type string, name string"))
    assert n == 2 and sorted(r.problems for r in bad.collect()) == [["name"], ["type"]]
    ids = sorted(r.id for r in store.get_all_entities().collect())
    n, bad = store.create_edges(spark.createDataFrame([(ids[0], ids[1], "works_for", None), (ids[0], ids[0], "self", 1.0), (ids[0], 99, "lost", 1.0), (ids[0], ids[1], "heavy", 2.0)], "from_id long, to_id long, type string, weight double"))
    assert n == 1 and store.get_all_edges().first().weight == 1.0
    assert sorted(p for r in bad.collect() for p in r.problems) == ["self_loop", "to_id unknown", "weight"]
    n, bad = store.create_communities(spark.createDataFrame([(ids,), ([],)], "entity_ids array<long>"))
    assert n == 1 and bad.count() == 1
    store.update_community_summary(1, "about")
    assert store.communities.read().first().summary == "about"
    assert store.get_relationships_between(ids).count() == 1 and store.get_node(ids[0]).count() == 1 and store.get_entities_by_ids([]).count() == 0


def test_problems(spark):
    edges = spark.createDataFrame([(1, None, 2, "x", 0.5), (2, 1, 2, None, -0.1)], "id long, from_id long, to_id long, type string, weight double")
    assert [r.p for r in edges.select(schemas.edge_problems().alias("p")).collect()] == [["from_id"], ["type", "weight"]]


def test_ingest_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = ChunkStore(spark, f"file://{tmp_path}/store")
    run = lambda: ingest(documents(spark, str(tmp_path / "in")), store, Sentence(), models.HashProvider(dim=8).embed, str(tmp_path / "state")).awaitTermination(120)
    (tmp_path / "in/a.txt").write_text("First one. Second one.")
    run()
    (tmp_path / "in/b.txt").write_text("Third one.")
    run()
    rows = store.read().collect()
    assert sorted(r.content for r in rows) == ["First one.", "Second one.", "Third one."] and all(len(r.embedding) == 8 for r in rows)


def test_breaker_stream(spark, tmp_path):
    rows = [(1, n, f"2024-01-01 00:00:{n:02d}", f) for n, f in enumerate([True, True, True, False, True])] + [(2, 9, "2024-01-01 00:00:00", True)]
    df = spark.createDataFrame(rows, "provider long, event_id long, ts string, failed boolean").selectExpr("provider", "event_id", "to_timestamp(ts) ts", "failed")
    df.write.parquet(f"{tmp_path}/calls")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/calls")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = circuit_breaker(stream).writeStream.format("memory").queryName("breaker").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(180)
    out = {(r.provider, r.event_id): (r.streak, r.open) for r in spark.table("breaker").collect()}
    assert out == {(1, 0): (1, False), (1, 1): (2, False), (1, 2): (3, True), (1, 3): (0, False), (1, 4): (1, False), (2, 9): (1, False)}
    q = windowed_failures(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert {(r.provider, r.calls, r.failures) for r in spark.table("windows").collect()} == {(1, 5, 4), (2, 1, 1)}


def test_positions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v").repartition(5)
    out = positions(df, ["v"]).collect()
    assert sorted((r.v, r.position) for r in out) == [(n, n + 1) for n in range(1000)]
    assert sorted(r.position for r in positions(df, start=10).collect()) == list(range(10, 1010))
    assert positions(df.where("false"), ["v"]).count() == 0


def test_changes_of_two_writers_and_a_crash(spark, tmp_path):
    """Both writers' rows stay, readers never see half a change, and a batch that is run again is stored once."""
    a = ChunkStore(spark, f"file://{tmp_path}/c")
    rows = lambda *ids: spark.createDataFrame([(i, f"text {i}") for i in ids], "id long, content string")
    a.insert(rows(1, 2), ("s", 0))
    assert a.insert(rows(1, 2), ("s", 0)) == 0 and a.insert(rows(3), ("s", 1)) == 1
    b = ChunkStore(spark, f"file://{tmp_path}/c")
    real, done = b._write, []

    def slow(df):
        if not done:
            done.append(1)
            a.insert(rows(4))
        return real(df)

    b._write = slow
    b.insert(spark.createDataFrame([("five",)], "content string"))
    assert sorted(r.id for r in a.read().collect()) == [1, 2, 3, 4, 5]
    (tmp_path / "c" / "pointers" / f"{99:012d}.json").write_text('{"parts": [')
    assert a.read().count() == 5 and a.insert(rows(6)) == 1 and b.read().count() == 6
    before = a._current()[1]["parts"]
    assert a.delete([4]) == 1 and len(set(before) & set(a._current()[1]["parts"])) == len(before) - 1
    assert a.delete([4]) == 0 and sorted(r.id for r in a.get(rows(1, 4)).collect()) == [1]


def test_failed_chunks_are_kept(spark, tmp_path):
    from sagebrook.streaming.ingest import failures

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Good words here.")
    (tmp_path / "in" / "b.txt").write_text("bad words here.")
    store = ChunkStore(spark, f"file://{tmp_path}/store")

    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [[1.0, 0.0] for _ in texts]

    ingest(documents(spark, str(tmp_path / "in")), store, Sentence(), picky, str(tmp_path / "state")).awaitTermination(120)
    assert store.read().count() + failures(store).read().count() == 2 and failures(store).read().where("error IS NULL").count() == 0
