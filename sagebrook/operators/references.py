"""References to records that do not exist: keyed orphan state, maintained incrementally.

State lives in a folder that all executors share, in buckets by the key that is referred to: the parent index (target, key, born, gone)
and the references with the kind of orphan they are, null where the target is found.  A batch of new references probes the parent
index; arriving parents and deletions are combined by key, resolve the waiting orphans of their keys or reopen them.
Only the buckets of the batch's keys are read and written anew.  A batch ends with a numbered manifest that names the current version of
every bucket: what was written before it is not seen, so a crash loses at most the batch, and another process goes on from the last
manifest.  Counts of orphans are kept by bucket, a snapshot a batch.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrook.storage import dropped, numbers, read_numbered, shared_folder, write_new, written

REF = ("tab", "field", "rec_id", "ref_id", "target", "at")
#: A key is hot with more than this share of a batch's references; so there are at most 1/HOT hot keys.
HOT, SALTS = 0.001, 32
#: Buckets of the state, and rows of a batch from which a bucket is written by several tasks.
BUCKETS, BUCKET_ROWS = 16, 1_000_000
_PARENTS = "target string, key long, born timestamp_ntz, gone timestamp_ntz, bucket int"
_REFS = "tab string, field string, rec_id long, ref_id long, target string, at timestamp_ntz, kind string, bucket int"
_COUNTS = "tab string, field string, kind string, period string, n long, bucket int"


@dataclass(frozen=True)
class Reference:
    """A column of keys in a table: ``column`` (a key or an array of keys) of ``table`` leads to ``target``."""

    table: str
    column: str
    target: str


def references(tables: dict[str, DataFrame], specs: list[Reference]) -> DataFrame:
    """All references (tab, field, rec_id, ref_id, target, at) of tables with ``id`` and ``inserted_at``.

    Null keys, null arrays, empty arrays and nulls in arrays are no references.
    """
    out = None
    for spec in specs:
        df = tables[spec.table]
        array = df.schema[spec.column].dataType.typeName() == "array"
        key = F.explode(F.array_distinct(spec.column)) if array else F.col(spec.column)
        one = df.select(F.lit(spec.table).alias("tab"), F.lit(spec.column).alias("field"), F.col("id").alias("rec_id"), key.alias("ref_id"), F.lit(spec.target).alias("target"), F.col("inserted_at").alias("at")).where("ref_id IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out


def _kind(born: Column, gone: Column, at: Column) -> Column:
    return F.when(born.isNull(), "missing").when(gone >= born, "deleted").when(born > at, "late")


def _probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """``refs`` with born and gone of their parents; hot keys are salted on both sides."""
    n = refs.groupBy("target", "ref_id").agg(F.count("*").alias("n"))
    total = F.lit(refs.count() * HOT)
    hot = F.broadcast(n.where((F.col("n") > total) & (F.col("n") > 1000)).select(F.col("target").alias("t"), F.col("ref_id").alias("k"), F.lit(True).alias("hot")))  # at most 1 / HOT rows
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("rec_id", "field"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    left = refs.join(hot, (F.col("target") == F.col("t")) & (F.col("ref_id") == F.col("k")), "left").withColumn("salt", salt).drop("t", "k", "hot")
    spread = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    right = parents.join(hot, (F.col("target") == F.col("t")) & (F.col("key") == F.col("k")), "left").select(F.col("target").alias("p_target"), F.col("key").alias("p_key"), "born", "gone", spread.alias("p_salt"))
    on = (F.col("target") == F.col("p_target")) & (F.col("ref_id") == F.col("p_key")) & (F.col("salt") == F.col("p_salt"))
    return left.join(right, on, "left").drop("p_target", "p_key", "p_salt", "salt")


class OrphanLedger:
    """Incremental state of one set of referring and referred tables.

    ``ingest`` takes references as of :func:`references`, parents (target, key, at) and deletions
    (target, key, at); each may be None or empty.  Batches may come in any order and more than once: the state after the last one
    depends only on what came.  A reference is ``missing`` if its target has no such key, else ``deleted``
    if the latest deletion is not before the latest arrival, else ``late`` if the target arrived after the
    referring record, else found.  Of a reference that comes several times the earliest time counts; null keys are ignored; a null time of
    the referring record is never late; a parent without time counts as always there.

    ``folder`` names the state; one that exists is continued.  There may be one writer at a time: of two that write the same version the
    second fails.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, buckets: int = BUCKETS):
        self.spark = spark
        self.folder = (folder or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}").rstrip("/")
        self.buckets, self.version, self.current = buckets, 0, {"parents": {}, "refs": {}, "counts": {}}
        held = read_numbered(spark, f"{self.folder}/manifests")
        if held:
            state = json.loads(held)
            self.buckets, self.current = state["buckets"], state["current"]
        self.version = max(numbers(spark, f"{self.folder}/manifests"), default=0)

    def _state(self, table: str, schema: str, buckets: list[str] | None = None) -> DataFrame:
        versions = {b: v for b, v in self.current[table].items() if buckets is None or b in buckets}
        paths = [f"{self.folder}/{v}/{table}/bucket={b}" for b, v in sorted(versions.items())]
        if not paths:
            return self.spark.createDataFrame([], schema).drop("bucket")
        return self.spark.read.schema(schema.rsplit(",", 1)[0]).parquet(*paths)

    def _bucket(self, target: str, key: str) -> Column:
        return F.pmod(F.xxhash64(target, key), F.lit(self.buckets)).cast("int").alias("bucket")

    @staticmethod
    def _changes(arrivals: DataFrame | None, deletions: DataFrame | None) -> DataFrame | None:
        long_ago = F.lit("0001-01-01").cast("timestamp_ntz")
        none = F.lit(None).cast("timestamp_ntz")
        parts = []
        if arrivals is not None:
            parts.append(arrivals.select("target", "key", F.coalesce(F.col("at").cast("timestamp_ntz"), long_ago).alias("born"), none.alias("gone")))
        if deletions is not None:
            parts.append(deletions.select("target", "key", none.alias("born"), F.col("at").cast("timestamp_ntz").alias("gone")))
        if not parts:
            return None
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.where("target IS NOT NULL AND key IS NOT NULL").groupBy("target", "key").agg(F.max("born").alias("born"), F.max("gone").alias("gone"))

    def _save(self, df: DataFrame, table: str, version: str, rows: int) -> None:
        """One folder a bucket; large batches spread a bucket over tasks."""
        salt = F.pmod(F.xxhash64("rec_id"), F.lit(1 + rows // (BUCKET_ROWS * self.buckets))) if "rec_id" in df.columns else F.lit(0)
        df.repartition("bucket", salt).write.partitionBy("bucket").option("compression", "zstd").mode("overwrite").parquet(f"{self.folder}/{version}/{table}")

    def ingest(self, refs: DataFrame | None = None, arrivals: DataFrame | None = None, deletions: DataFrame | None = None) -> OrphanLedger:
        """Apply one batch."""
        changes = self._changes(arrivals, deletions)
        changes = written(changes.select("*", self._bucket("target", "key")), "changes") if changes is not None else None
        new = None
        if refs is not None:
            new = refs.select("tab", "field", "rec_id", "ref_id", "target", F.col("at").cast("timestamp_ntz").alias("at")).where("ref_id IS NOT NULL").groupBy("tab", "field", "rec_id", "ref_id", "target").agg(F.min("at").alias("at"))
            new = written(new.select("*", self._bucket("target", "ref_id")), "refs")
        counts: dict[int, int] = {}
        for part in (changes, new):
            for r in part.groupBy("bucket").count().collect() if part is not None else ():
                counts[r.bucket] = counts.get(r.bucket, 0) + r["count"]
        number, touched = self.version + 1, sorted(map(str, counts))
        version = f"v{number}-{uuid.uuid4().hex[:8]}"
        if touched:
            old = self._state("parents", _PARENTS, touched)
            parents = old if changes is None else old.unionByName(changes.drop("bucket")).groupBy("target", "key").agg(F.max("born").alias("born"), F.max("gone").alias("gone"))
            self._save(parents.select("*", self._bucket("target", "key")), "parents", version, 0)
            known = self._state("refs", _REFS, touched)
            every = known.select(*REF)
            if new is not None:
                every = every.unionByName(new.select(*REF))
                every = every.groupBy("tab", "field", "rec_id", "ref_id", "target").agg(F.min("at").alias("at")).select(*REF) if self.current["refs"] else every
            at = self.spark.read.schema(_PARENTS).parquet(f"{self.folder}/{version}/parents").drop("bucket")
            judged = _probe(every, at).withColumn("kind", _kind(F.col("born"), F.col("gone"), F.col("at")))
            self._save(judged.select(*REF, "kind", self._bucket("target", "ref_id")), "refs", version, sum(counts.values()))
            after = self.spark.read.schema(_REFS).parquet(f"{self.folder}/{version}/refs")
            self._save(self._counted(after, "bucket"), "counts", version, 0)
            for table in self.current:
                self.current[table] = {b: v for b, v in self.current[table].items() if b not in touched} | dict.fromkeys(self._present(version, table), version)
        for part in (changes, new):
            if part is not None:
                dropped(part)
        write_new(self.spark, f"{self.folder}/manifests", number, json.dumps({"buckets": self.buckets, "current": self.current}))
        self.version = number
        return self

    def _present(self, version: str, table: str) -> list[str]:
        """Buckets that a version has rows of."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{version}/{table}")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
        names = [f.getPath().getName() for f in found]
        return [n.split("=")[1] for n in names if n.startswith("bucket=")]

    @staticmethod
    def _counted(refs: DataFrame, *by: str) -> DataFrame:
        period = F.date_format("at", "yyyy-MM").alias("period")
        return refs.where("kind IS NOT NULL").groupBy("tab", "field", "kind", period, *by).agg(F.count("*").alias("n"))

    def orphans(self) -> DataFrame:
        """Open references (tab, field, rec_id, ref_id, kind, period); period is the month of the referring record."""
        return self._state("refs", _REFS).where("kind IS NOT NULL").select("tab", "field", "rec_id", "ref_id", "kind", F.date_format("at", "yyyy-MM").alias("period"))

    def snapshot(self) -> DataFrame:
        """Counts of open references (tab, field, kind, period, n), from those kept by bucket."""
        return self._state("counts", _COUNTS).groupBy("tab", "field", "kind", "period").agg(F.sum("n").alias("n"))

    def snapshots(self) -> list[DataFrame]:
        """The counts after every batch whose files are still there, oldest first."""
        out, own = [], self.current
        for number in numbers(self.spark, f"{self.folder}/manifests"):
            held = read_numbered(self.spark, f"{self.folder}/manifests", number)
            if held:
                self.current = json.loads(held)["current"]
                out.append(self.snapshot())
        self.current = own
        return out

    def vacuum(self) -> None:
        """Delete the versions of buckets that the current state doesn't read; snapshots before it go with them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path
        fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for number in numbers(self.spark, f"{self.folder}/manifests"):
            if number < self.version:
                fs.delete(path(f"{self.folder}/manifests/{number:012d}.json"), False)
        for version in [f.getPath().getName() for f in fs.listStatus(path(self.folder))]:
            for table, held in self.current.items() if version.startswith("v") else ():
                for bucket in self._present(version, table) if fs.exists(path(f"{self.folder}/{version}/{table}")) else ():
                    if held.get(bucket) != version:
                        fs.delete(path(f"{self.folder}/{version}/{table}/bucket={bucket}"), True)

    def close(self) -> None:
        """Delete the state."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
