"""Tables as immutable Parquet parts with numbered pointers.

A change writes new parts and then a pointer with the next number, which fails if another writer was faster: such a change is tried again
on what that one wrote.  Readers follow the last finished pointer, so they see the old or the new table; a crash leaves nothing
behind but an unnamed folder.  Appends add a part; deletes and updates write anew only the parts that hold a row they change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebrook import schemas
from sagebrook.operators import search
from sagebrook.operators.positions import positions
from sagebrook.storage import numbers, read_numbered, write_new

#: How often a change is tried while other writers are faster.
ATTEMPTS = 10


class SnapshotTable:
    """A table of one schema with a key."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str = "id"):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key

    def _current(self) -> tuple[int, dict]:
        """(number to build on, state): parts, and the last batch of every stream."""
        taken = max(numbers(self.spark, f"{self.path}/pointers"), default=0)
        held = read_numbered(self.spark, f"{self.path}/pointers")
        return taken, json.loads(held) if held else {"parts": [], "batches": {}}

    def _changed(self, change: Callable[[dict], tuple[dict, int]]) -> int:
        """Apply ``change(state) -> (new state, rows)`` to the newest state, again while other writers are faster."""
        for _ in range(ATTEMPTS):
            taken, state = self._current()
            new, n = change(state)
            if new == state:
                return n
            try:
                write_new(self.spark, f"{self.path}/pointers", taken + 1, json.dumps(new))
                return n
            except RuntimeError:
                continue
        raise RuntimeError(f"other writers hold {self.path}")

    def _of(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in parts))

    def read(self) -> DataFrame:
        return self._of(self._current()[1]["parts"])

    def _write(self, df: DataFrame) -> tuple[str, int]:
        part, seen = f"part-{uuid.uuid4().hex}", Observation()
        df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).observe(seen, F.count("*").alias("n")).write.parquet(f"{self.path}/{part}")
        return part, int(seen.get.get("n", 0))

    def _filled(self, df: DataFrame) -> DataFrame:
        """Absent columns, times of now to the second, and empty maps and arrays for missing ones."""
        now = F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")
        for f in self.schema.fields:
            column = F.col(f.name) if f.name in df.columns else F.lit(None)
            column = column.cast(f.dataType)
            if f.name in ("inserted_at", "updated_at"):
                column = F.coalesce(column, now)
            elif isinstance(f.dataType, T.MapType):
                column = F.coalesce(column, F.create_map().cast(f.dataType))
            elif f.name in ("source_chunk_ids",):
                column = F.coalesce(column, F.array().cast(f.dataType))
            df = df.withColumn(f.name, column)
        return df

    def _numbered(self, df: DataFrame, parts: list[str]) -> DataFrame:
        """Keys for rows without one, above the largest stored or given key; each partition counts from its own offset."""
        if self.key in df.columns:
            named, unnamed = df.where(F.col(self.key).isNotNull()), df.where(F.col(self.key).isNull())
        else:
            named, unnamed = None, df.withColumn(self.key, F.lit(None).cast("long"))
        if unnamed.limit(1).count() == 0:
            return df
        highest = self._of(parts).agg(F.max(self.key)).first()[0] or 0
        if named is not None:
            highest = max(highest, named.agg(F.max(self.key)).first()[0] or 0)
        given = positions(unnamed.drop(self.key), None, self.key, highest + 1)
        return given if named is None else named.unionByName(given, allowMissingColumns=True)

    def insert(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append rows; returns how many.  A ``batch`` (stream, number) that is not above the stream's last one was stored before: it is left out."""

        def change(state: dict) -> tuple[dict, int]:
            if batch is not None and state["batches"].get(batch[0], -1) >= batch[1]:
                return state, 0
            part, n = self._write(self._filled(self._numbered(df, state["parts"])))
            return {"parts": [*state["parts"], part], "batches": state["batches"] | (dict([batch]) if batch else {})}, n

        return self._changed(change)

    def _touched(self, parts: list[str], keys: DataFrame) -> list[str]:
        """The parts that hold a row of one of the keys."""
        if not parts:
            return []
        files = self._of(parts).withColumn("__file", F.input_file_name()).join(keys, self.key, "left_semi").select(F.element_at(F.split("__file", "/"), -2).alias("part")).distinct()
        hit = {r.part for r in files.collect()}  # as many rows as there are parts
        return [p for p in parts if p in hit]

    def _keys(self, keys: list | DataFrame) -> DataFrame:
        if isinstance(keys, DataFrame):
            return keys.select(F.col(keys.columns[0]).cast(self.schema[self.key].dataType).alias(self.key)).where(F.col(self.key).isNotNull()).distinct()
        return self.spark.createDataFrame([(k,) for k in keys], T.StructType([self.schema[self.key]])).distinct()

    def get(self, keys: list | DataFrame) -> DataFrame:
        """Rows of a few keys, or of those in the first column of a table."""
        rows = self.read()
        if isinstance(keys, DataFrame):
            return rows.join(self._keys(keys), self.key, "left_semi")
        return rows.where(F.col(self.key).isin(keys)) if keys else rows.where("false")

    def delete(self, keys: list | DataFrame) -> int:
        """Delete by key; returns how many rows went."""
        gone = self._keys(keys)

        def change(state: dict) -> tuple[dict, int]:
            touched = self._touched(state["parts"], gone)
            if not touched:
                return state, 0
            rows = self._of(touched)
            part, n = self._write(rows.join(gone, self.key, "left_anti"))
            return state | {"parts": [*(p for p in state["parts"] if p not in touched), part]}, rows.count() - n

        return self._changed(change)

    def update(self, values: DataFrame, column: str) -> None:
        """Set a column of the rows that ``values(key, column)`` names; of several values of a key the largest counts."""
        new = values.groupBy(self.key).agg(F.max(column).alias("__new")).withColumn("__hit", F.lit(True))

        def change(state: dict) -> tuple[dict, int]:
            touched = self._touched(state["parts"], self._keys(values.select(self.key)))
            if not touched:
                return state, 0
            joined = self._of(touched).join(new, self.key, "left").withColumn(column, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(column)))
            if "updated_at" in self.schema.names:
                joined = joined.withColumn("updated_at", F.when(F.col("__hit"), F.date_trunc("second", F.current_timestamp()).cast("timestamp_ntz")).otherwise(F.col("updated_at")))
            part, n = self._write(joined)
            return state | {"parts": [*(p for p in state["parts"] if p not in touched), part]}, n

        self._changed(change)


def checked(df: DataFrame, problems) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``problems``)."""
    marked = df.withColumn("problems", problems)
    return marked.where(F.size("problems") == 0).drop("problems"), marked.where(F.size("problems") > 0)


class ChunkStore(SnapshotTable):
    """The chunk table: insert, search, get, delete."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, schemas.CHUNK)

    def insert(self, df: DataFrame, batch: tuple[str, int] | None = None) -> int:
        return super().insert(checked(df, schemas.chunk_problems())[0], batch)

    def search(self, vector: list[float], limit: int = 10) -> DataFrame:
        """Nearest chunks; score 1 / (1 + distance)."""
        return search.semantic(self.read(), vector, limit, score="decaying")


def from_chunks(chunks: DataFrame, source: str | None = None) -> DataFrame:
    """Store rows of chunker output: offsets and index go into the metadata."""
    extra = F.create_map(F.lit("start_byte"), F.col("start_byte").cast("string"), F.lit("end_byte"), F.col("end_byte").cast("string"), F.lit("chunk_index"), F.col("index").cast("string"))
    own = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin("start_byte", "end_byte", "chunk_index"))
    out = chunks.withColumn("metadata", F.map_concat(own, extra)).drop("start_byte", "end_byte", "index")
    return out.withColumn("source", F.lit(source)) if source is not None else out


class GraphStore:
    """Entities, edges and communities with validated writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.entities = SnapshotTable(spark, f"{path}/entities", schemas.ENTITY)
        self.edges = SnapshotTable(spark, f"{path}/edges", schemas.EDGE)
        self.communities = SnapshotTable(spark, f"{path}/communities", schemas.COMMUNITY)

    def create_nodes(self, df: DataFrame) -> tuple[int, DataFrame]:
        """(rows stored, rows refused with their problems)."""
        table = self.entities
        good, bad = checked(table._filled(df if "id" in df.columns else df.withColumn("id", F.lit(None).cast("long"))), schemas.entity_problems())
        return table.insert(good), bad

    def create_edges(self, df: DataFrame) -> tuple[int, DataFrame]:
        """As nodes; edges of unknown ends are refused too; a missing weight is 1."""
        table = self.edges
        good, bad = checked(table._filled(df if "id" in df.columns else df.withColumn("id", F.lit(None).cast("long"))).withColumn("weight", F.coalesce("weight", F.lit(1.0))), schemas.edge_problems())
        ids = self.entities.read().select(F.col("id").alias("k"))
        known = good.join(ids, good["from_id"] == ids["k"], "left_semi").join(ids, good["to_id"] == ids["k"], "left_semi")
        lost = schemas.dangling_edges(good, self.entities.read()).withColumn("problems", F.array(F.concat(F.col("missing"), F.lit(" unknown")))).drop("missing")
        return table.insert(known), bad.unionByName(lost)

    def create_communities(self, df: DataFrame) -> tuple[int, DataFrame]:
        table = self.communities
        good, bad = checked(table._filled(df if "id" in df.columns else df.withColumn("id", F.lit(None).cast("long"))).withColumn("level", F.coalesce("level", F.lit(0))), schemas.community_problems())
        return table.insert(good), bad

    def get_node(self, id_: int) -> DataFrame:
        return self.entities.get([id_])

    def get_all_entities(self) -> DataFrame:
        return self.entities.read()

    def get_all_edges(self) -> DataFrame:
        return self.edges.read()

    def get_entities_by_ids(self, ids: list[int]) -> DataFrame:
        return self.entities.get(ids)

    def get_relationships_between(self, ids: list[int]) -> DataFrame:
        return self.edges.read().where(F.col("from_id").isin(ids) & F.col("to_id").isin(ids))

    def update_community_summary(self, id_: int, summary: str) -> None:
        spark = self.communities.spark
        self.communities.update(spark.createDataFrame([(id_, summary)], "id long, summary string"), "summary")
