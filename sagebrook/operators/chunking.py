"""Chunking of a column: one row a text in, one row a chunk out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebrook.functions.chunkers import Character, Chunker
from sagebrook.storage import spread

CHUNK_FIELDS = [
    T.StructField("content", T.StringType()),
    T.StructField("start_byte", T.IntegerType()),
    T.StructField("end_byte", T.IntegerType()),
    T.StructField("index", T.IntegerType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
]


def chunk(df: DataFrame, chunker: Chunker, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Chunks of every text with the columns ``keep``: narrow, one Arrow pass, no shuffle.

    Null texts have no chunk; whether empty texts have one is the chunker's rule; repeated rows are kept.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    clash = {f.name for f in CHUNK_FIELDS} & set(keep)
    if clash:
        raise ValueError(f"columns {sorted(clash)} clash with those of chunks")
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, columns = [], [[], [], [], [], []]
            for n, value in enumerate(batch.column(len(keep)).to_pylist()):
                for c in chunker.chunk(value):
                    rows.append(n)
                    for column, name in zip(columns, ("content", "start_byte", "end_byte", "index", "metadata")):
                        column.append(list(c[name].items()) if name == "metadata" else c[name])
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns[: len(keep)]), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*keep, *(f.name for f in CHUNK_FIELDS)])

    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, T.StructType([*(df.schema[c] for c in keep), *CHUNK_FIELDS]))


def sentence_chunks(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Sentences (keep..., index, content) by built-in expressions only, for texts whose sentences all fit."""
    keep = keep or []
    parts = F.filter(F.split(F.regexp_replace(text, r"([.!?])[ \t\n\r\f\x0b]+", "$1\u0001"), "\u0001"), lambda x: F.trim(F.regexp_replace(x, r"[\t\n\r\f\x0b]", " ")) != "")
    return df.select(*keep, F.posexplode(parts).alias("index", "content"))


def paragraph_chunks(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Paragraphs (keep..., index, content), trimmed, by built-in expressions only."""
    keep = keep or []
    strip = lambda x: F.regexp_replace(x, r"^[ \t\n\r\f\x0b]+|[ \t\n\r\f\x0b]+$", "")
    parts = F.filter(F.transform(F.split(text, r"(?:\r?\n[ \t\n\r\f\x0b]*){2,}"), strip), lambda x: x != "")
    return df.select(*keep, F.posexplode(parts).alias("index", "content"))


def chunk_text(df: DataFrame, text: str = "text", max_chars: int = 500, overlap: int = 50, keep: list[str] | None = None) -> DataFrame:
    """Pieces of texts by size as (keep..., index, content); an overlap of the whole piece still moves on."""
    return chunk(df, Character(max_chars, overlap), text, keep).select(*(keep if keep is not None else [c for c in df.columns if c != text]), "index", "content")


def valid_chunk(text: Column, content: Column, start: Column, end: Column) -> Column:
    """Whether a chunk's bytes are those of its source between its offsets."""
    size = end - start
    return (F.octet_length(content) == size) & (F.substring(F.encode(text, "UTF-8"), start + 1, size) == F.encode(content, "UTF-8"))
