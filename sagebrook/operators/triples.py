"""The graph as subject-predicate-object triples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name spaces of the terms.
ENTITY, TYPE, REL, PROP, EDGE, COMMUNITY, META = (f"urn:{n}:" for n in ("entity", "type", "rel", "prop", "edge", "community", "meta"))
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDF_TYPE = RDF + "type"


def uri(space: str, name: Column) -> Column:
    return F.concat(F.lit(space), name.cast("string"))


def parse_uri(term: Column) -> Column:
    """(space, name) of a term: ``urn:<space>:<name>``; null for others.  Names of digits read as ids with ``try_cast``."""
    space = F.regexp_extract(term, r"^urn:(entity|type|rel|prop|edge|community|meta):", 1)
    return F.when(space != "", F.struct(space.alias("space"), F.regexp_replace(term, r"^urn:[a-z]+:", "").alias("name")))


def is_entity(term: Column) -> Column:
    return term.startswith(ENTITY)


def is_relationship(term: Column) -> Column:
    return term.startswith(REL)


def is_property(term: Column) -> Column:
    return term.startswith(PROP)


def literal_type(value: Column) -> Column:
    """Type of a literal written as text: integer, float, boolean, json or string."""
    return (
        F.when(value.rlike(r"^[+-]?\d{1,18}$"), "integer").when(value.rlike(r"^[+-]?\d+\.\d+(?:[eE][+-]?\d+)?$"), "float")
        .when(value.isin("true", "false"), "boolean").when(value.rlike(r"(?s)^\s*[\[{].*[\]}]\s*$"), "json").otherwise("string")
    )


def _triple(s: Column, p: Column, o: Column, kind: Column | str) -> Column:
    return F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), (F.lit(kind) if isinstance(kind, str) else kind).alias("o_type"))


def _spread(df: DataFrame, triples: list[Column], extra: Column | None = None) -> DataFrame:
    """Triples of each row without those whose object is null; set semantics are left to :func:`store`."""
    all_ = F.array(*triples)
    all_ = F.concat(all_, extra) if extra is not None else all_
    return df.select(F.explode(F.filter(all_, lambda t: t["o"].isNotNull())).alias("t")).select("t.*")


def _properties(subject: Column) -> Column:
    entries = F.map_entries(F.coalesce("properties", F.create_map().cast("map<string,string>")))
    return F.transform(entries, lambda e: _triple(subject, F.concat(F.lit(PROP), e["key"]), e["value"], literal_type(e["value"])))


def entity_triples(entities: DataFrame) -> DataFrame:
    """Type, name, properties, cited chunks and the flag of an embedding of each entity."""
    s = uri(ENTITY, F.col("id"))
    chunks = F.transform(F.coalesce("source_chunk_ids", F.array().cast("array<bigint>")), lambda c: _triple(s, F.lit(META + "source_chunk"), c, "integer"))
    base = [_triple(s, F.lit(RDF_TYPE), uri(TYPE, F.col("type")), "uri"), _triple(s, F.lit(PROP + "name"), F.col("name"), "string")]
    if "embedding" in entities.columns:
        base.append(_triple(s, F.lit(META + "has_embedding"), F.when(F.col("embedding").isNotNull(), "true"), "boolean"))
    return _spread(entities, base, F.concat(_properties(s), chunks))


def edge_triples(edges: DataFrame) -> DataFrame:
    """One triple an edge; edges with a weight other than 1 or with properties are statements of their own as well."""
    a, b, r = uri(ENTITY, F.col("from_id")), uri(ENTITY, F.col("to_id")), uri(REL, F.col("type"))
    plain = _triple(a, r, b, "uri")
    rich = (F.col("weight").isNotNull() & (F.col("weight") != 1.0)) | (F.size(F.coalesce("properties", F.create_map().cast("map<string,string>"))) > 0)
    e = uri(EDGE, F.col("id"))
    stated = F.array(
        _triple(e, F.lit(RDF_TYPE), F.lit(RDF + "Statement"), "uri"), _triple(e, F.lit(RDF + "subject"), a, "uri"), _triple(e, F.lit(RDF + "predicate"), r, "uri"),
        _triple(e, F.lit(RDF + "object"), b, "uri"), _triple(e, F.lit(PROP + "weight"), F.col("weight"), "float"),
    )
    return _spread(edges, [plain], F.when(rich, F.concat(stated, _properties(e))).otherwise(F.array().cast("array<struct<s:string,p:string,o:string,o_type:string>>")))


def community_triples(communities: DataFrame) -> DataFrame:
    """Level, summary and members of each community, members both ways."""
    s = uri(COMMUNITY, F.col("id"))
    ids = F.filter(F.array_distinct("entity_ids"), lambda x: x.isNotNull())
    inward = F.transform(ids, lambda x: _triple(s, F.lit(META + "has_member"), F.concat(F.lit(ENTITY), x.cast("string")), "uri"))
    outward = F.transform(ids, lambda x: _triple(F.concat(F.lit(ENTITY), x.cast("string")), F.lit(META + "member_of"), s, "uri"))
    base = [_triple(s, F.lit(RDF_TYPE), F.lit(TYPE + "community"), "uri"), _triple(s, F.lit(PROP + "level"), F.col("level"), "integer"), _triple(s, F.lit(PROP + "summary"), F.col("summary"), "string")]
    return _spread(communities, base, F.concat(inward, outward))


def store(parts: list[DataFrame]) -> DataFrame:
    """Triples as a set."""
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["s", "p", "o"])


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples of a pattern; None is a variable."""
    for column, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(column) == value)
    return triples


def without(triples: DataFrame, gone: DataFrame) -> DataFrame:
    return triples.join(gone.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


def entities_from(triples: DataFrame) -> DataFrame:
    """(id, type, name, properties, source_chunk_ids) of the entities of a triple table; unknown predicates are ignored."""
    rows = triples.where(is_entity(F.col("s"))).withColumn("id", F.expr(f"try_cast(substring(s, {len(ENTITY) + 1}) AS BIGINT)")).where("id IS NOT NULL")
    own = F.col("p").startswith(PROP) & (F.col("p") != PROP + "name")
    entry = F.when(own, F.struct(F.expr(f"substring(p, {len(PROP) + 1})").alias("key"), F.col("o").alias("value")))
    found = rows.groupBy("id").agg(
        F.max(F.when(F.col("p") == RDF_TYPE, F.expr(f"substring(o, {len(TYPE) + 1})"))).alias("type"), F.max(F.when(F.col("p") == PROP + "name", F.col("o"))).alias("name"),
        F.array_sort(F.collect_set(entry)).alias("e"), F.array_sort(F.collect_set(F.when(F.col("p") == META + "source_chunk", F.col("o").cast("long")))).alias("source_chunk_ids"),
    )
    return found.select("id", "type", "name", F.map_from_entries("e").alias("properties"), "source_chunk_ids")


def write_indices(triples: DataFrame, path: str, partitions: int | None = None) -> None:
    """Three sorted copies, for lookups by subject, predicate and object; row groups are skipped by their statistics."""
    for name, order in (("spo", ["s", "p", "o"]), ("pos", ["p", "o", "s"]), ("osp", ["o", "s", "p"])):
        ranged = triples.repartitionByRange(partitions, *order) if partitions else triples.repartitionByRange(*order)
        ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark, path: str, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples of a pattern from the copy whose order starts with a bound term."""
    name = "spo" if s is not None and (o is None or p is not None) else "osp" if o is not None and p is None else "pos" if p is not None else "spo"
    return match(spark.read.parquet(f"{path}/{name}"), s, p, o)
