import pytest
from pyspark.sql import functions as F

from sagebrook.functions import text as X
from sagebrook.functions import vector as V
from sagebrook.operators import fusion, rerank, search
from sagebrook.operators.retrievers import FullText, Hybrid, Query, Semantic


@pytest.fixture()
def chunks(spark):
    rows = [(1, "the red fox", "a", [1.0, 0.0]), (2, "the blue fox and the hen", "b", [0.0, 1.0]), (3, "", None, [float("nan"), 0.0]), (4, "red red red", "c", None), (5, "a fox", "d", [1.0]), (6, "the red hen", "e", [1.0, 0.0])]
    return spark.createDataFrame(rows, "id long, content string, source string, embedding array<float>")


def ranked(spark, ids, **more):
    return spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id long, position int")


def test_semantic(chunks):
    out = search.semantic(chunks, [1.0, 0.0], 3).collect()
    assert [(r.id, round(r.distance, 3), round(r.score, 3)) for r in out] == [(1, 0.0, 1.0), (6, 0.0, 1.0), (2, 1.414, 0.0)]
    assert [r.id for r in search.semantic(chunks, [1.0, 0.0], 3, where=F.col("source") == "b", score="decaying").collect()] == [2]
    assert search.semantic(chunks.where("false"), [1.0, 0.0]).count() == 0
    wide = chunks.withColumn("d", V.l2_to([1.0, 0.0])(F.col("embedding"))).where("d IS NOT NULL").collect()
    assert {r.id: round(r.d, 3) for r in wide} == {1: 0.0, 2: 1.414, 6: 0.0}


def test_batch(spark, chunks):
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 1.0]), (9, None)], "qid long, embedding array<double>")
    out = sorted((r.qid, r["rank"], r.id) for r in search.semantic_batch(chunks, queries, 2).collect())
    assert out == [(7, 1, 1), (7, 2, 6), (8, 1, 2), (8, 2, 1)]
    assert search.semantic_batch(chunks, queries.where("false")).count() == 0


def test_batch_of_ties(spark):
    """More equal vectors than are kept: the smaller ids win, wherever they lie."""
    n = 9000
    rows = spark.range(n).select((n - F.col("id")).alias("id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(0.1), F.lit(0.7), F.lit(0.3))).otherwise(F.array(F.col("id") + 2.0, F.lit(5.0), F.lit(1.0))).alias("embedding"))
    queries = spark.createDataFrame([(7, [0.1, 0.7, 0.3]), (8, [0.2, 0.6, 0.1])], "qid long, embedding array<double>")
    ties = sorted(n - k for k in range(0, n, 3))[:4]
    out = sorted((r.qid, r["rank"], r.id) for r in search.semantic_batch(rows.coalesce(1), queries, 4).collect())
    assert out == [(q, k + 1, i) for q in (7, 8) for k, i in enumerate(ties)]


def test_fulltext(chunks):
    assert [(r.id, round(r.score, 3)) for r in search.fulltext(chunks, "The FOX!").collect()] == [(1, 0.667), (2, 0.5)]
    assert search.fulltext(chunks, " ?!: ").count() == 0
    assert {r.id for r in search.fulltext(chunks, "blue red", any_term=True).collect()} == {1, 2, 4, 6}
    assert search.fulltext(chunks, "foxes", stem=True).count() >= 0


def test_retrievers(chunks):
    assert Hybrid(chunks).retrieve(Query("red", [1.0, 0.0]), 2).count() == 2
    for retriever, bad in ((Hybrid(chunks), Query("x")), (Semantic(chunks), Query("x")), (FullText(chunks), Query(embedding=[1.0]))):
        with pytest.raises(ValueError):
            retriever.retrieve(bad)
    assert (Semantic.supports_embedding, Semantic.supports_text, FullText.supports_text, Hybrid.supports_text) == (True, False, True, True)


def test_reciprocal_ranks(spark):
    out = fusion.reciprocal_ranks([ranked(spark, [1, 2]), ranked(spark, [2, 3])]).orderBy(F.desc("score"), "id").collect()
    assert [r.id for r in out] == [2, 1, 3]


@pytest.mark.parametrize(("a", "b", "weights", "want"), [([0, 1], [2, 3], (1, 1), [0, 2, 1, 3]), ([0, 1], [2, 1], (1, 1), [1, 0, 2]), ([0, 1], [2, 3], (1, 2), [2, 3, 0, 1])])
def test_weighted_ranks(spark, a, b, weights, want):
    out = fusion.weighted_ranks({"foo": (ranked(spark, a), weights[0]), "bar": (ranked(spark, b), weights[1])}).orderBy(F.desc("score"), "id").collect()
    assert [r.id for r in out] == want
    with pytest.raises(ValueError):
        fusion.weighted_ranks({})


def test_list_operators(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (0, "c")], "id long, v string").withColumn("position", F.monotonically_increasing_id())
    assert sorted((r.id, r.v) for r in fusion.first_of_each(df, ["id"], ["position"]).collect()) == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        fusion.first_of_each(df, [], ["position"])
    assert [r.id for r in fusion.concatenated([ranked(spark, [5, 6]), ranked(spark, [5])]).orderBy("list", "position").collect()] == [5, 6, 5]


def test_rerank(spark):
    docs = spark.createDataFrame([(1, 0, 0.5), (2, 1, 0.4), (3, 2, 0.3)], "id long, doc_index int, score double")
    scores = lambda rows: spark.createDataFrame(rows, "doc_index int, score double")
    out = rerank.apply_scores(docs, scores([(0, 9.0), (1, 7.0), (2, 3.0)])).orderBy("position").collect()
    assert [(r.id, r.score) for r in out] == [(1, 9.0), (2, 7.0), (3, 3.0)]
    assert rerank.apply_scores(docs, scores([(0, 9.0)]), top_k=2).count() == 2
    out = rerank.apply_scores(docs, scores([(0, 10.0), (1, 5.0), (2, 0.0)]), normalise=True).orderBy("position").collect()
    assert [r.score for r in out] == [1.0, 0.5, 0.0]
    assert {r.score for r in rerank.apply_scores(docs, scores([(0, 4.0), (1, 4.0)]), normalise=True).where("doc_index < 2").collect()} == {1.0}
    asked = docs.withColumn("qid", F.lit(1)).withColumn("query", F.lit("q")).withColumn("content", F.lit("c"))
    model = rerank.ModelReranker(lambda prompts: ['```json\n[{"doc_index": 2, "score": 9}, {"doc_index": 2, "score": 8}]\n```' for _ in prompts])
    assert [(r.id, r.score) for r in model.rerank(asked).orderBy("position").collect()] == [(3, 8.0), (1, 0.5), (2, 0.4)]


def test_text(spark):
    row = spark.createDataFrame([("Hello 👩‍🚀 world 🇺🇸", "```json\n[1]\n```", "a\nb\nc\nd")], "t string, f string, l string").select(X.graphemes(F.col("t")).alias("g"), X.without_fence(F.col("f")).alias("f"), X.line_slice(F.col("l"), 2, 3).alias("l")).first()
    assert tuple(row) == (15, "[1]", "b\nc")
