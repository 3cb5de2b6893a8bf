"""Reranking of results by scores from a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.functions.text import rendered, without_fence

PROMPT = 'Rate how relevant each document is to the query, from 0 to 10. Answer with a JSON array of {{"doc_index": n, "score": s}}.\n\nQuery: {query}\n\nDocuments:\n{documents}'.replace("{{", "{").replace("}}", "}")


def passthrough(docs: DataFrame) -> DataFrame:
    return docs


def parse_scores(answer: Column) -> Column:
    """(doc_index, score) pairs of a model's JSON answer, with or without a code fence; null if it is no array."""
    return F.from_json(without_fence(answer), "array<struct<doc_index:int,score:double>>")


def build_prompt(docs: DataFrame, query: Column, by: list[str], template: str = PROMPT) -> DataFrame:
    """One prompt a query: its documents numbered from 0 in order of ``doc_index``."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_index", "content"))), lambda d: F.concat(F.lit("["), d["doc_index"].cast("string"), F.lit("] "), d["content"])), "\n")
    return docs.groupBy(*by).agg(lines.alias("documents"), F.first(query).alias("query")).withColumn("prompt", rendered(template, query=F.col("query"), documents=F.col("documents")))


def apply_scores(docs: DataFrame, scores: DataFrame, by: list[str] | None = None, top_k: int | None = None, normalise: bool = False) -> DataFrame:
    """Documents with the model's scores, best first.

    ``docs`` has ``doc_index`` and ``score``, ``scores`` (doc_index, score, optionally ``position``).  Of several scores of one
    document the last by ``position`` counts, without positions the largest; documents without one keep theirs; ``normalise`` maps the scores of a query to 0..1 (all equal
    gives 1).  Ties keep the order of the documents.
    """
    by = by or []
    keys = [*by, "doc_index"]
    last = F.max_by("score", "position") if "position" in scores.columns else F.max("score")
    new = scores.groupBy(*keys).agg(last.alias("new"))
    if normalise:
        w = Window.partitionBy(*(by or [F.lit(0)]))
        low, high = F.min("new").over(w), F.max("new").over(w)
        new = new.withColumn("new", F.when(high == low, F.lit(1.0)).otherwise((F.col("new") - low) / (high - low)))
    out = docs.join(new, keys, "left").withColumn("score", F.coalesce("new", F.col("score").cast("double"))).drop("new")
    out = out.withColumn("position", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.desc("score"), "doc_index")))
    return out if top_k is None else out.where(F.col("position") <= top_k)


class ModelReranker:
    """Reranks the results of many queries by a text model, one call a query.

    ``generate`` maps a list of prompts to answers and runs in Arrow batches.
    """

    def __init__(self, generate: Callable[[list[str]], list[str]], template: str = PROMPT, top_k: int | None = None, normalise: bool = False):
        self.generate, self.template, self.top_k, self.normalise = generate, template, top_k, normalise

    def rerank(self, docs: DataFrame, query: str = "query", by: str = "qid") -> DataFrame:
        from sagebrook.models import complete

        asked = complete(build_prompt(docs, F.col(query), [by], self.template).select(by, "prompt"), self.generate)
        scores = asked.select(by, F.posexplode(parse_scores(F.col("response"))).alias("position", "x")).select(by, "position", "x.doc_index", "x.score")
        return apply_scores(docs, scores, [by], self.top_k, self.normalise)
