"""Whole files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagebrook.functions.text import line_slice


def load_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(source, document): each file whole; a missing path fails."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("document"))


def _text(path: str) -> str:
    """A file's text; paths with a scheme are opened in the storage that it names."""
    if "://" in path and not path.startswith("file:"):
        from pyarrow import fs

        storage, inner = fs.FileSystem.from_uri(path)
        with storage.open_input_stream(inner) as stream:
            return stream.read().decode("utf-8")
    with open(path.removeprefix("file://"), encoding="utf-8") as file:
        return file.read()


def load_sources(ingestion: DataFrame, source: str = "source") -> DataFrame:
    """Rows with ``document``, the content of the file each row names; files are read on the executors."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for path in batch.column(batch.schema.get_field_index(source)).to_pylist():
                if path is None:
                    texts.append(None)
                    continue
                texts.append(_text(path))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "document"])

    from pyspark.sql import types as T

    return ingestion.mapInArrow(run, T.StructType([*ingestion.schema.fields, T.StructField("document", T.StringType())]))


def lines(files: DataFrame, start: int | None = None, end: int | None = None, text: str = "document") -> DataFrame:
    """Files cut to a range of lines."""
    return files.withColumn(text, line_slice(F.col(text), start, end))
