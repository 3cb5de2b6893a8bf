"""Schemas of the engine's tables, and the rules that rows must keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_STRINGS = T.MapType(T.StringType(), T.StringType())


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


CHUNK = _schema(
    ("id", T.LongType()), ("content", T.StringType()), ("source", T.StringType()), ("embedding", T.ArrayType(T.FloatType())),
    ("metadata", _STRINGS), ("inserted_at", T.TimestampNTZType()), ("updated_at", T.TimestampNTZType()),
)
ENTITY = _schema(
    ("id", T.LongType()), ("type", T.StringType()), ("name", T.StringType()), ("properties", _STRINGS), ("embedding", T.ArrayType(T.FloatType())),
    ("source_chunk_ids", T.ArrayType(T.LongType())), ("inserted_at", T.TimestampNTZType()), ("updated_at", T.TimestampNTZType()),
)
EDGE = _schema(
    ("id", T.LongType()), ("from_id", T.LongType()), ("to_id", T.LongType()), ("type", T.StringType()), ("weight", T.DoubleType()),
    ("properties", _STRINGS), ("inserted_at", T.TimestampNTZType()), ("updated_at", T.TimestampNTZType()),
)
COMMUNITY = _schema(
    ("id", T.LongType()), ("level", T.IntegerType()), ("summary", T.StringType()), ("entity_ids", T.ArrayType(T.LongType())),
    ("inserted_at", T.TimestampNTZType()), ("updated_at", T.TimestampNTZType()),
)
TRIPLE = _schema(("s", T.StringType()), ("p", T.StringType()), ("o", T.StringType()), ("o_type", T.StringType()))
RESULT = _schema(("id", T.StringType()), ("content", T.StringType()), ("score", T.DoubleType()), ("source", T.StringType()), ("metadata", _STRINGS))
GENERATION = _schema(
    ("qid", T.LongType()), ("query", T.StringType()), ("query_embedding", T.ArrayType(T.DoubleType())), ("retrieval_results", T.MapType(T.StringType(), T.ArrayType(RESULT))),
    ("context", T.StringType()), ("context_sources", T.ArrayType(T.StringType())), ("prompt", T.StringType()), ("response", T.StringType()),
    ("evaluations", _STRINGS), ("halted", T.BooleanType()), ("errors", T.ArrayType(T.StringType())),
)


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(F.regexp_replace(c, r"\s", " ")) == "")


def problem(rules: dict[str, Column]) -> Column:
    """Names of the broken rules of a row, in order; empty if it keeps them all.  A rule that is null is broken."""
    return F.filter(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(n)) for n, ok in rules.items())), lambda x: x.isNotNull())


def chunk_problems() -> Column:
    return problem({"content": ~_blank(F.col("content"))})


def entity_problems() -> Column:
    """A missing type is broken, also when a writer has spelled it ``nil``."""
    return problem({"type": ~_blank(F.col("type")) & (F.lower("type") != "nil"), "name": ~_blank(F.col("name"))})


def edge_problems() -> Column:
    return problem(
        {
            "from_id": F.col("from_id").isNotNull(), "to_id": F.col("to_id").isNotNull(), "type": ~_blank(F.col("type")),
            "weight": F.col("weight").isNull() | F.col("weight").between(0.0, 1.0), "self_loop": ~(F.coalesce(F.col("from_id") == F.col("to_id"), F.lit(False))),
        }
    )


def community_problems() -> Column:
    return problem({"level": F.col("level") >= 0, "entity_ids": F.size("entity_ids") > 0})


def dangling_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges of which an end is no stored entity; the larger side is exchanged once a key."""
    ids = entities.select(F.col("id").alias("k")).distinct()
    no_from = edges.join(ids, edges["from_id"] == ids["k"], "left_anti").withColumn("missing", F.lit("from_id"))
    no_to = edges.join(ids, edges["to_id"] == ids["k"], "left_anti").withColumn("missing", F.lit("to_id"))
    return no_from.unionByName(no_to)


def copies_once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row a key.  For tables whose rows of one key are copies of a record."""
    return df.dropDuplicates([key])
