"""Byte-level BPE by merge ranks, on whole columns.

Method: a text is cut by the vocabulary's split pattern; each piece becomes a doubly linked
list of symbols with a priority queue of the merges of neighbours.  The lowest rank is applied
first, at equal rank the leftmost; entries of symbols that have changed since are stale and
skipped.  Decoding concatenates the strings of the vocabulary.
"""

from __future__ import annotations

import base64
import heapq
import importlib.util
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sagebrook.storage import spread

# The split pattern of the byte-level vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces whose ids a worker remembers; the table is emptied when full, nothing depends on it.
REMEMBERED = 400_000


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """Place of a vocabulary: ``SAGEBROOK_TOKENIZERS``, else the installed package of public ones."""
    folder = os.environ.get("SAGEBROOK_TOKENIZERS")
    if not folder:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec else "/opt/tokenizers"
    return os.path.join(folder, name if "." in name else name + ".tiktoken")


def _letters_of_bytes() -> dict[str, int]:
    """The printable stand-ins that JSON vocabularies use for bytes."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    moved = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + n): b for n, b in enumerate(moved)}


class _Memory(dict):
    """Ids of pieces; computes what is missing."""

    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = tuple(self._encode(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class BytePairTokenizer:
    """Encoder and decoder of one vocabulary file (``.tiktoken`` ranks or a ``.json`` model)."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as file:
                model = json.load(file)["model"]
            back = _letters_of_bytes()
            self.ranks = {bytes(back[c] for c in s): i for s, i in model["vocab"].items() if all(c in back for c in s)}
        else:
            with open(path, "rb") as file:
                self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self._strings: dict[int, bytes] = {i: s for s, i in self.ranks.items()}
        self._split = regex.compile(SPLIT)
        self._memory = _Memory(self._merge)

    def _merge(self, raw: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        whole = ranks.get(raw)
        if whole is not None:
            return [whole]
        n = len(raw)
        text: list[bytes | None] = [raw[i : i + 1] for i in range(n)]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            rank = ranks.get(raw[i : i + 2])
            if rank is not None:
                queue.append((rank, i, 2))
        heapq.heapify(queue)
        while queue:
            rank, i, size = heapq.heappop(queue)
            left = text[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(text[j]) != size:
                continue  # stale: one of the two has grown since
            text[i] = joined = left + text[j]
            text[j] = None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get(joined + text[k])) is not None:
                    heapq.heappush(queue, (rank, i, size + len(text[k])))
            p = before[i]
            if p >= 0 and (rank := ranks.get(text[p] + joined)) is not None:
                heapq.heappush(queue, (rank, p, size + len(text[p])))
        return [ranks[s] for s in text if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, without special tokens; an empty list for an empty text and for None."""
        if not text:
            return []
        return list(chain.from_iterable(map(self._memory.__getitem__, self._split.findall(text))))

    def count(self, text: str | None) -> int:
        """Number of ids of a text."""
        if not text:
            return 0
        return sum(map(len, map(self._memory.__getitem__, self._split.findall(text))))

    def decode(self, ids) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement character."""
        return b"".join(map(self._strings.__getitem__, ids or ())).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def tokenizer(path: str) -> BytePairTokenizer:
    """One tokenizer a worker and vocabulary."""
    return BytePairTokenizer(path)


def _id_lists(path: str, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            parts = [np.asarray(coder.encode(text), dtype=np.int32) for text in batch.column(column).to_pylist()]
            ends = np.zeros(len(parts) + 1, dtype=np.int32)
            np.cumsum([len(p) for p in parts], out=ends[1:])
            flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, type=pa.int32()))
            yield pa.RecordBatch.from_arrays([*(c for n, c in enumerate(batch.columns) if n != column), lists], names=[*(f.name for n, f in enumerate(batch.schema) if n != column), "ids"])

    return run


def _counts(path: str, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            n = pa.array([coder.count(text) for text in batch.column(column).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(batch.columns) if k != column), n], names=[*(f.name for k, f in enumerate(batch.schema) if k != column), "n_tokens"])

    return run


def _mapped(df: DataFrame, text: str, keep: list[str], name: str, kind: T.DataType, run) -> DataFrame:
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(name, kind)])
    return spread(df.select(*keep, F.col(text).alias("__text"))).mapInArrow(run, schema)


def encode_ids(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``ids ARRAY<INT>`` of every row, in one narrow pass without a shuffle.

    Empty and null texts have an empty list; strings of special tokens are ordinary text; repeated rows
    are kept.  Only the named columns are read.  ``keep`` may not hold a column named ``ids``.
    """
    keep = keep or []
    return _mapped(df, text, keep, "ids", T.ArrayType(T.IntegerType(), True), _id_lists(path or vocabulary_path(), len(keep)))


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``n_tokens BIGINT`` of every row; 0 for empty and null texts."""
    keep = keep or []
    return _mapped(df, text, keep, "n_tokens", T.LongType(), _counts(path or vocabulary_path(), len(keep)))


def decode_ids(df: DataFrame, ids: str = "ids", keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Columns ``keep`` and ``text`` of every row of token ids; null and empty lists give an empty text."""
    keep, path = keep or [], path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)
        for batch in batches:
            texts = pa.array([coder.decode(x) for x in batch.column(len(keep)).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], names=[*keep, "text"])

    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("text", T.StringType())])
    return df.select(*keep, F.col(ids).alias("__ids")).mapInArrow(run, schema)
