"""One row a query through retrieval, context, prompt, answer and evaluation.

Every stage but the context and prompt builders leaves halted rows alone; a failed model call adds its error to
the row and halts it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.functions.text import rendered, without_fence
from sagebrook.models import Embed, Generate, complete, embed
from sagebrook.operators import fusion
from sagebrook.schemas import GENERATION, RESULT

TRIAD_PROMPT = (
    "Rate from 1 (not at all) to 5 (completely), with a reason each: is the context relevant to the query, is the response supported by the context, is the response relevant to "
    "the query? Answer as JSON with context_relevance_reasoning, context_relevance_score, groundedness_reasoning, groundedness_score, answer_relevance_reasoning and "
    "answer_relevance_score.\n\nQuery: {query}\n\nContext:\n{context}\n\nResponse:\n{response}"
)
HALLUCINATION_PROMPT = "Is the response a correct answer to the query by the context alone? Answer YES or NO only.\n\nContext:\n{context}\n\nQuery: {query}\n\nResponse: {response}"
TRIAD = "struct<context_relevance_reasoning:string,context_relevance_score:int,groundedness_reasoning:string,groundedness_score:int,answer_relevance_reasoning:string,answer_relevance_score:int>"


def new(queries: DataFrame, query: str = "query", qid: str = "qid") -> DataFrame:
    """Rows of the generation schema for (qid, query)."""
    blank = {"halted": F.lit(False), "errors": F.array().cast("array<string>"), "evaluations": F.create_map().cast("map<string,string>"), "retrieval_results": F.create_map().cast(GENERATION["retrieval_results"].dataType), "qid": F.col(qid).cast("long"), "query": F.col(query)}
    return queries.select(*(blank.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in GENERATION.fields))


def halt(df: DataFrame, when: Column) -> DataFrame:
    return df.withColumn("halted", F.col("halted") | when)


def add_error(df: DataFrame, error: Column) -> DataFrame:
    """The error in front of those before, where it isn't null."""
    return df.withColumn("errors", F.when(error.isNotNull(), F.concat(F.array(error), "errors")).otherwise(F.col("errors")))


def _modelled(df: DataFrame, call: Callable[[DataFrame], DataFrame], value: Callable[[Column], Column], target: str, source: str) -> DataFrame:
    """A model stage on the rows that aren't halted."""
    live = call(df.where("NOT halted"))
    live = live.withColumn(target, F.when(F.col("error").isNull(), value(F.col(source))).otherwise(F.col(target)))
    live = halt(add_error(live, F.col("error")), F.col("error").isNotNull())
    return live.select(*df.columns).unionByName(df.where("halted"))


def embed_query(df: DataFrame, function: Embed) -> DataFrame:
    return _modelled(df, lambda x: embed(x, function, "query", "__out"), lambda c: c.cast("array<double>"), "query_embedding", "__out")


def put_results(df: DataFrame, key: str, results: DataFrame) -> DataFrame:
    """Results of (qid, position, RESULT fields...) under a key of ``retrieval_results``; queries without any have an empty list."""
    fields = [f.name for f in RESULT.fields]
    rows = results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("position", F.struct(*(F.col(c).cast(RESULT[c].dataType).alias(c) for c in fields)).alias("r"))), lambda a, b: (a["position"] - b["position"]).cast("int")).alias("x"))
    joined = df.join(rows.select("qid", F.transform("x", lambda p: p["r"]).alias("__found")), "qid", "left")
    kind = GENERATION["retrieval_results"].dataType
    entry = F.create_map(F.lit(key), F.coalesce("__found", F.array().cast(kind.valueType))).cast(kind)
    merged = F.map_concat(F.map_filter("retrieval_results", lambda k, v: k != key), entry)
    return joined.withColumn("retrieval_results", F.when(F.col("halted"), F.col("retrieval_results")).otherwise(merged)).select(*df.columns)


def results_of(df: DataFrame, key: str) -> DataFrame:
    """(qid, position, RESULT fields...) of a key; a row without the key is an error."""
    found = F.when(F.map_contains_key("retrieval_results", key), F.col("retrieval_results")[key]).otherwise(F.raise_error(F.lit(f"no results under {key}")).cast(GENERATION["retrieval_results"].dataType.valueType))
    return df.select("qid", F.posexplode(found).alias("position", "r")).select("qid", (F.col("position") + 1).alias("position"), "r.*")


def retrieve(df: DataFrame, key: str, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of ``search(queries)`` under a key; if it fails, its error is added to the rows, which go on without results.

    Only building the plan is guarded; a failing task fails the action as everywhere.
    """
    try:
        return put_results(df, key, search(df.where("NOT halted")))
    except Exception as error:  # noqa: BLE001
        return add_error(df, F.when(~F.col("halted"), F.lit(f"{type(error).__name__}: {error}")))


def concatenate(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """The lists of several keys one after the other under ``out``; a row without a key is an error."""
    lists = [df.where("NOT halted").transform(results_of, k) for k in keys]
    stacked = fusion.concatenated(lists).withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("list", "position")).cast("int"))
    return put_results(df, out, stacked)


def fuse(df: DataFrame, weights: dict[str, float], out: str, identity: list[str] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of the lists of several keys under ``out``, best first, ties by id."""
    if not weights:
        raise ValueError("no results to fuse")
    live = df.where("NOT halted")
    found = fusion.weighted_ranks({k: (results_of(live, k), w) for k, w in weights.items()}, identity or ["id"], ["qid"])
    return put_results(df, out, found.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id")).cast("int")))


def deduplicate(df: DataFrame, key: str, unique_by: list[str]) -> DataFrame:
    """A key's list without later rows that agree in the named fields."""
    first = fusion.first_of_each(results_of(df.where("NOT halted"), key), ["qid", *unique_by], ["position"]) if unique_by else fusion.first_of_each(df, [], [])
    return put_results(df, key, first.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("position")).cast("int")))


def build_context(df: DataFrame, key: str, build: Callable[[Column], Column] | None = None) -> DataFrame:
    """The context, by default the contents of a key's results, one a line."""
    build = build or (lambda results: F.array_join(F.transform(results, lambda r: r["content"]), "\n"))
    return df.withColumn("context", build(F.col("retrieval_results")[key]))


def build_context_sources(df: DataFrame, key: str, build: Callable[[Column], Column] | None = None) -> DataFrame:
    build = build or (lambda results: F.transform(results, lambda r: F.coalesce(r["source"], F.lit("unknown"))))
    return df.withColumn("context_sources", build(F.col("retrieval_results")[key]))


def build_prompt(df: DataFrame, template: str = "Answer by the context.\n\nContext:\n{context}\n\nQuestion: {query}") -> DataFrame:
    return df.withColumn("prompt", rendered(template, context=F.col("context"), query=F.col("query")))


def generate_response(df: DataFrame, generate: Generate) -> DataFrame:
    """Answers; a row without prompt that isn't halted is an error of the row."""
    checked = halt(add_error(df, F.when(~F.col("halted") & F.col("prompt").isNull(), "prompt is missing")), F.col("prompt").isNull())
    return _modelled(checked, lambda x: complete(x, generate, "prompt", "__out"), lambda c: c, "response", "__out")


def _put(name: str, value: Column) -> Column:
    return F.map_concat(F.map_filter("evaluations", lambda k, v: k != name), F.create_map(F.lit(name), value))


def evaluate_triad(df: DataFrame, generate: Generate) -> DataFrame:
    """``evaluations['rag_triad']``: the JSON of three reasons and scores."""
    asked = df.withColumn("__ask", rendered(TRIAD_PROMPT, query=F.col("query"), context=F.col("context"), response=F.col("response")))
    return _modelled(asked, lambda x: complete(x, generate, "__ask", "__out"), lambda c: _put("rag_triad", F.to_json(F.from_json(without_fence(c), TRIAD))), "evaluations", "__out").drop("__ask")


def triad_scores(df: DataFrame) -> DataFrame:
    """(qid, three reasons and scores) of evaluated rows."""
    return df.select("qid", F.from_json(F.col("evaluations")["rag_triad"], TRIAD).alias("t")).select("qid", "t.*")


def detect_hallucination(df: DataFrame, generate: Generate) -> DataFrame:
    """``evaluations['hallucination']``: true unless the answer is exactly YES."""
    asked = df.withColumn("__ask", rendered(HALLUCINATION_PROMPT, query=F.col("query"), context=F.col("context"), response=F.col("response")))
    return _modelled(asked, lambda x: complete(x, generate, "__ask", "__out"), lambda c: _put("hallucination", (c != "YES").cast("string")), "evaluations", "__out").drop("__ask")
