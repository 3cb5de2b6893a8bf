"""Entities and relationships from texts, by a text model, and the resolution of their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebrook.functions.text import rendered, without_fence
from sagebrook.models import Generate, complete

# Kinds of entities and relationships.
ENTITY_TYPES = ["person", "organization", "location", "event", "concept", "technology", "document"]
RELATIONSHIP_TYPES = ["works_for", "located_in", "created_by", "part_of", "related_to", "uses", "depends_on"]

ENTITY_PROMPT = "List the entities of the text as a JSON array of objects with name, type, description and aliases.\nTypes: {types}\n\nText:\n{text}"
RELATIONSHIP_PROMPT = "List the relationships between the entities as a JSON array of objects with source, target, type, description and weight.\nTypes: {types}\nEntities: {entities}\n\nText:\n{text}"


def parse_entities(answer: Column) -> Column:
    """Entities of a JSON answer: those without name are dropped, absent values have defaults; null if it is no array."""
    rows = F.from_json(without_fence(answer), "array<struct<name:string,type:string,description:string,aliases:array<string>>>")
    fill = lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["type"], F.lit("concept")).alias("type"), F.coalesce(e["description"], F.lit("")).alias("description"), F.coalesce(e["aliases"], F.array().cast("array<string>")).alias("aliases"))
    return F.transform(F.filter(rows, lambda e: e["name"].isNotNull()), fill)


def parse_relationships(answer: Column) -> Column:
    """Relationships of a JSON answer; those without source or target are dropped."""
    rows = F.from_json(without_fence(answer), "array<struct<source:string,target:string,type:string,description:string,weight:double>>")
    fill = lambda r: F.struct(r["source"].alias("source"), r["target"].alias("target"), F.coalesce(r["type"], F.lit("related_to")).alias("type"), F.coalesce(r["description"], F.lit("")).alias("description"), F.coalesce(r["weight"], F.lit(1.0)).alias("weight"))
    return F.transform(F.filter(rows, lambda r: r["source"].isNotNull() & r["target"].isNotNull()), fill)


def extract(texts: DataFrame, generate: Generate, text: str = "text", types: list[str] | None = None) -> DataFrame:
    """Texts with ``entities``, ``relationships`` and ``error``; a failed or unreadable answer leaves its column null."""
    first = complete(texts.withColumn("prompt", rendered(ENTITY_PROMPT, types=F.lit(", ".join(types or ENTITY_TYPES)), text=F.col(text))), generate, name="answer")
    first = first.withColumn("entities", parse_entities(F.col("answer"))).withColumnRenamed("error", "entity_error").drop("answer", "prompt")
    named = F.array_join(F.transform("entities", lambda e: e["name"]), ", ")
    second = complete(first.withColumn("prompt", rendered(RELATIONSHIP_PROMPT, types=F.lit(", ".join(RELATIONSHIP_TYPES)), entities=named, text=F.col(text))), generate, name="answer")
    second = second.withColumn("relationships", parse_relationships(F.col("answer")))
    unread = F.when(F.col("entities").isNull(), "invalid_entity_format").when(F.col("relationships").isNull(), "invalid_relationship_format")
    return second.withColumn("error", F.coalesce("entity_error", "error", unread)).drop("answer", "prompt", "entity_error")


def resolve(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """Entities after merging: ``mapping(canonical, aliases)`` names what is the same.

    A canonical name that is an entity takes over the aliases; one that isn't takes the row of its first alias if that
    is an entity, else nothing; entities that the mapping doesn't name stay.  Of equal names the last row by description counts.
    """
    kept = entities.where("name IS NOT NULL")
    one = kept.groupBy("name").agg(F.max_by(F.struct("type", "description", "aliases"), F.struct("description", "type")).alias("e")).select("name", "e.*")
    none = F.array().cast("array<string>")
    m = mapping.select("canonical", F.coalesce("aliases", none).alias("others")).withColumn("first", F.try_element_at("others", F.lit(1)))
    direct = m.join(one, m["canonical"] == one["name"]).select("name", "type", "description", F.array_distinct(F.concat(F.coalesce("aliases", none), "others")).alias("aliases"))
    absent = m.join(one.select(F.col("name").alias("canonical")), "canonical", "left_anti")
    template = absent.join(one, absent["first"] == one["name"]).select(F.col("canonical").alias("name"), "type", "description", F.col("others").alias("aliases"))
    named = m.select(F.col("canonical").alias("name")).union(m.select(F.explode("others").alias("name"))).distinct()
    rest = kept.join(named, "name", "left_anti").select("name", "type", "description", "aliases")
    return direct.unionByName(template).unionByName(rest)
