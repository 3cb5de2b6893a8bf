"""Models as pluggable callables.

An embedding function maps a list of texts to vectors, a text function a list of prompts to answers.
They run in Arrow batches on the executors; a failed call marks its rows and never the job.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embed = Callable[[list[str]], list]
Generate = Callable[[list[str]], list[str]]


class Provider(Protocol):
    """What a model backend offers; ``None`` where it lacks a capability."""

    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def generate(self, prompts: list[str]) -> list[str]: ...


class NotSupported(Exception):
    """A provider lacks the capability that was asked for."""


@dataclass(frozen=True)
class HashProvider:
    """Deterministic stand-in without a model: vectors of hashed words, answers by a rule."""

    name: str = "hash"
    dim: int = 64
    answer: Callable[[str], str] | None = None

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for n, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[n, h % self.dim] += 1 if h >> 63 else -1
        length = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return (out / np.where(length == 0, 1, length)).tolist()

    def generate(self, prompts: list[str]) -> list[str]:
        return [self.answer(p) if self.answer else f"answer {hashlib.blake2b(p.encode(), digest_size=4).hexdigest()}" for p in prompts]


@dataclass(frozen=True)
class HttpProvider:
    """A backend behind an injected transport ``send(path, body) -> (status, body)``; decodes three shapes of answers."""

    name: str
    send: Callable[[str, dict], tuple[int, Any]]
    style: str = "openai"
    embedding_model: str = "default"
    text_model: str = "default"

    def _call(self, path: str, body: dict) -> Any:
        status, answer = self.send(path, body)
        if status != 200:
            raise RuntimeError(f"HTTP request failed with status code {status}")
        return answer

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.style == "openai":
            return [x["embedding"] for x in self._call("/v1/embeddings", {"model": self.embedding_model, "input": texts})["data"]]
        if self.style == "cohere":
            return self._call("/v2/embed", {"model": self.embedding_model, "texts": texts, "embedding_types": ["float"], "input_type": "search_document"})["embeddings"]["float"]
        return self._call("/api/embed", {"model": self.embedding_model, "input": texts})["embeddings"]

    def generate(self, prompts: list[str]) -> list[str]:
        return [self._text(p) for p in prompts]

    def _text(self, prompt: str) -> str:
        body = {"model": self.text_model, "messages": [{"role": "user", "content": prompt}], "stream": False}
        if self.style == "openai":
            return self._call("/v1/chat/completions", body)["choices"][0]["message"]["content"]
        if self.style == "cohere":
            return self._call("/v2/chat", body)["message"]["content"][0]["text"]
        return self._call("/api/chat", body)["message"]["content"]

    def deltas(self, events: Iterator[str]) -> Iterator[str]:
        """Text pieces of a streamed answer: server-sent events or one JSON object a line."""
        for line in events:
            line = line.strip().removeprefix("data:").strip()
            if not line or line == "[DONE]" or line.startswith(("event:", ":")):
                continue
            data = json.loads(line)
            if self.style == "openai":
                piece = (data.get("choices") or [{}])[0].get("delta", {}).get("content")
            elif self.style == "cohere":
                piece = data.get("delta", {}).get("message", {}).get("content", {}).get("text")
            else:
                piece = data.get("message", {}).get("content")
            if piece:
                yield piece


@dataclass(frozen=True)
class ServingProvider:
    """A local model's batch functions; a missing one is a ValueError when it is called."""

    embeddings: Embed | None = None
    texts: Generate | None = None
    name: str = "local"

    def embed(self, texts):
        if self.embeddings is None:
            raise ValueError("no embedding serving is configured")
        return self.embeddings(texts)

    def generate(self, prompts):
        if self.texts is None:
            raise ValueError("no text serving is configured")
        return self.texts(prompts)


# Providers with their capabilities, prices per 1000 tokens and strengths.
CAPABILITIES = [
    ("gemini", True, True, True, 1_000_000, 0.000075, 0.000300, ["long_context", "multimodal", "embeddings", "cost", "speed"]),
    ("codex", False, True, True, 128_000, 0.00250, 0.01000, ["code_generation", "reasoning", "structured_output", "code_review"]),
    ("claude", False, True, True, 200_000, 0.00300, 0.01500, ["analysis", "writing", "safety", "agentic", "reasoning"]),
]
# The provider for each task.
BEST_FOR = {
    "embeddings": "gemini", "long_context": "gemini", "multimodal": "gemini", "cost": "gemini", "speed": "gemini", "code_generation": "codex", "code_review": "codex",
    "structured_output": "codex", "analysis": "claude", "writing": "claude", "agentic": "claude", "reasoning": "claude", "safety": "claude",
}


def capabilities(spark) -> DataFrame:
    """The registry as a table."""
    return spark.createDataFrame(CAPABILITIES, "provider string, embeddings boolean, tools boolean, streaming boolean, max_context int, cost_in double, cost_out double, strengths array<string>")


def can_handle(provider: str, capability: str) -> bool:
    row = next((c for c in CAPABILITIES if c[0] == provider), None)
    return bool(row) and {"embeddings": row[1], "tools": row[2], "streaming": row[3]}.get(capability, False) is True


def best_for(task: str, available: list[str] | None = None) -> str:
    """The provider for a task; unknown tasks go to the first available one."""
    return BEST_FOR.get(task) or next(iter(available or []), "gemini")


def _called(values: list, call: Callable[[list], list], size: int, retries: int) -> tuple[list, list]:
    """Results and errors of values, in calls of at most ``size``; nulls are not sent."""
    out, errors = [None] * len(values), [None] * len(values)
    at = [n for n, v in enumerate(values) if v is not None]
    for a in range(0, len(at), size):
        part = at[a : a + size]
        for attempt in range(retries + 1):
            try:
                got = list(call([values[n] for n in part]))
                if len(got) != len(part):
                    raise ValueError(f"{len(part)} inputs gave {len(got)} results")
                for n, x in zip(part, got):
                    out[n] = x
                break
            except Exception as e:  # noqa: BLE001
                if attempt == retries:
                    for n in part:
                        errors[n] = f"{type(e).__name__}: {e}"
                else:
                    time.sleep(0.1 * 2**attempt)
    return out, errors


def _applied(df: DataFrame, source: str, name: str, kind: T.DataType, arrow: pa.DataType, call, size: int, retries: int) -> DataFrame:
    keep = [c for c in df.columns if c not in (name, "error")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, errors = _called(batch.column(batch.schema.get_field_index(source)).to_pylist(), call, size, retries)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow), pa.array(errors, pa.string())], names=[*batch.schema.names, name, "error"])

    rows = df.select(*keep)
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, kind), T.StructField("error", T.StringType())]))


def complete(df: DataFrame, generate: Generate, prompt: str = "prompt", name: str = "response", batch: int = 16, retries: int = 0) -> DataFrame:
    """``df`` with the answers to its prompts and the ``error`` of a failed call."""
    return _applied(df, prompt, name, T.StringType(), pa.string(), generate, batch, retries)


def embed(df: DataFrame, function: Embed, text: str = "content", name: str = "embedding", batch: int = 100, retries: int = 0) -> DataFrame:
    """``df`` with the vectors of its texts, ``batch`` texts a call, and the ``error`` of a failed call."""
    return _applied(df, text, name, T.ArrayType(T.FloatType()), pa.list_(pa.float32()), function, batch, retries)


def with_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks joined with vectors by ``position``; unequal counts are a ValueError."""
    n, m = chunks.count(), vectors.count()
    if n != m:
        raise ValueError(f"{n} chunks and {m} embeddings")
    return chunks.drop("embedding").join(vectors.select("position", "embedding"), "position")


@dataclass
class EmbeddingService:
    """Embeds in batches and counts what it did."""

    function: Embed
    batch_size: int = 100
    stats: dict[str, int] = field(default_factory=lambda: {"texts_embedded": 0, "batches_processed": 0, "errors": 0})

    def embed_text(self, text: str) -> list[float]:
        return self.embed_texts([text])[0]

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for a in range(0, len(texts), self.batch_size):
            part = texts[a : a + self.batch_size]
            try:
                out.extend(self.function(part))
            except Exception:
                self.stats["errors"] += 1
                raise
            self.stats["batches_processed"] += 1
            self.stats["texts_embedded"] += len(part)
        return out

    def embed_and_prepare(self, chunks: DataFrame, source: str | None = None) -> DataFrame:
        """Chunker output with embeddings as rows of the chunk store."""
        from sagebrook.sources.snapshots import from_chunks

        return from_chunks(self.embed_chunks(chunks), source)

    def embed_chunks(self, chunks: DataFrame, text: str = "content") -> DataFrame:
        """Chunks with embeddings, on the executors; any failed call fails the action."""
        done = embed(chunks, self.function, text, batch=self.batch_size)
        return done.withColumn("embedding", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("array<float>")).otherwise(F.col("embedding"))).drop("error")
