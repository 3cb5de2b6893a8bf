"""Spans around the engine's steps, told to attached handlers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

# Names of the spans.
SPANS = ("generate_embedding", "generate_embeddings_batch", "generate_response", "retrieve", "detect_hallucination", "evaluate_rag_triad", "pipeline.step")
_handlers: dict[str, tuple[frozenset[str], Callable[[str, dict, dict], None]]] = {}


def events() -> list[str]:
    """Start, exception and stop of every span."""
    return [f"{s}.{e}" for s in SPANS for e in ("start", "exception", "stop")]


def attach(name: str, names: list[str], handler: Callable[[str, dict, dict], None]) -> None:
    """Call ``handler(event, measurements, metadata)`` for the named events."""
    _handlers[name] = (frozenset(names), handler)


def detach(name: str) -> None:
    _handlers.pop(name, None)


def _tell(event: str, measured: dict, metadata: dict) -> None:
    for names, handler in list(_handlers.values()):
        if event in names:
            handler(event, measured, metadata)


@contextmanager
def span(name: str, **metadata) -> Iterator[None]:
    began = time.monotonic()
    _tell(f"{name}.start", {"time": time.time()}, metadata)
    try:
        yield
    except Exception as error:
        _tell(f"{name}.exception", {"seconds": time.monotonic() - began}, metadata | {"error": error})
        raise
    _tell(f"{name}.stop", {"seconds": time.monotonic() - began}, metadata)
