"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage here.  A table written to the folder named by
``spark.checkpoint.dir`` survives the loss of any executor, is columnar and compressed,
and can be read with column pruning, which a checkpointed RDD can't.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where the setting is absent and all tasks run in this process (tests)."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{_SETTING} must name a folder that all executors share")
    own = getattr(spark, "_sagebrook_folder", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="sagebrook-")
        spark._sagebrook_folder = own
    return own


def written(df: DataFrame, label: str = "t") -> DataFrame:
    """``df`` as a table in the shared folder, read back: one execution, no lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    spark = df.sparkSession
    folder = shared_folder(spark).removeprefix("file://").rstrip("/")
    jvm = spark.sparkContext._jvm
    for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if folder not in path:
            continue
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _folder(spark: SparkSession, folder: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def write_new(spark: SparkSession, folder: str, number: int, text: str) -> None:
    """A numbered text of one line in a folder; RuntimeError if the number is taken by another writer."""
    jvm, fs, _ = _folder(spark, folder)
    try:
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{number:012d}.json"), False)
    except Exception as e:
        raise RuntimeError(f"another writer holds {folder} at {number}") from e
    out.write(bytearray((text + "\n").encode()))
    out.close()


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the texts in a folder, also of those that a writer has not finished."""
    _, fs, at = _folder(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n[:12]) for n in names if re.fullmatch(r"\d{12}\.json", n))


def read_numbered(spark: SparkSession, folder: str, number: int | None = None) -> str | None:
    """The text of a number, or without it the last one; unfinished ones are passed over."""
    jvm, fs, _ = _folder(spark, folder)
    for n in reversed(numbers(spark, folder) if number is None else [number]):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{n:012d}.json")
        if not fs.exists(path):
            continue
        stream = fs.open(path)
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text.endswith("\n"):
            return text
    return None


def small_enough(rows: int, width: int = 16, limit_mb: int = 32) -> bool:
    """Whether ``rows`` rows of about ``width`` bytes may be broadcast."""
    return rows * width <= limit_mb << 20


def semi_join(big: DataFrame, keys: DataFrame, on: str | list[str], width: int = 16, limit_mb: int = 32) -> DataFrame:
    """Rows of ``big`` whose key is in the written table ``keys``.

    The keys are counted first: they are broadcast only up to ``limit_mb``, beyond that both sides are
    exchanged.
    """
    keys = keys.select(*([on] if isinstance(on, str) else on))
    if small_enough(keys.count(), width, limit_mb):
        keys = F.broadcast(keys)
    return big.join(keys, on, "left_semi")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    For stages whose work outweighs their rows: a table in one small file would keep one core busy.  Tables large
    enough to be read by every core are left as they are, without an exchange.
    """
    if df.isStreaming:
        return df
    nodes = df._jdf.queryExecution().sparkPlan()
    todo, kinds = [nodes], []
    while todo:
        node = todo.pop()
        kinds.append(node.nodeName())
        todo += [node.children().apply(k) for k in range(node.children().size())]
    if any(word in kind for kind in kinds for word in ("Join", "Aggregate", "Exchange", "Sort", "Window", "Limit", "Generate")):
        return df  # it ends in an exchange, or counting its partitions would run it
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
