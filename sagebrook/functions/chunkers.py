"""Chunking kernels: one text in, spans out.

Spans are pairs of code point positions; lengths count grapheme clusters, offsets bytes of UTF-8.
A :class:`Ruler` measures both in constant time, so that every kernel passes over its text once.
White space is ASCII white space, as in the patterns' byte mode; limits that stand for bytes stay bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import regex

_END = re.compile(r"[.!?](?=[ \t\n\r\f\v]|$)")
_BREAK = re.compile(r"(?:\r?\n[ \t\n\r\f\v]*){2,}")
_SPACE = " \t\n\r\f\v"
Span = tuple[int, int]


class Ruler:
    """Grapheme and byte positions of a text."""

    def __init__(self, text: str):
        self.text = text
        n = len(text)
        if text.isascii():
            self._bytes = None
        else:
            sizes = np.ones(n + 1, np.int64)
            codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            sizes[1:] += (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
            sizes[0] = 0
            self._bytes = np.cumsum(sizes)
        simple = self._bytes is None and "\r\n" not in text
        self._edges = None if simple else [0, *(m.end() for m in regex.finditer(r"\X", text))]

    def byte(self, at: int) -> int:
        return at if self._bytes is None else int(self._bytes[at])

    def size(self, span: Span) -> int:
        """Graphemes of a span."""
        a, b = span
        if self._edges is None:
            return b - a
        whole = bisect_right(self._edges, b) - bisect_right(self._edges, a)
        return whole + (self._edges[bisect_right(self._edges, b) - 1] != b and b > a)

    def ahead(self, a: int, count: int) -> int:
        """Position ``count`` graphemes after ``a``."""
        if self._edges is None:
            return min(len(self.text), a + count)
        k = bisect_right(self._edges, a) - 1 + count
        return self._edges[min(k, len(self._edges) - 1)]


def _cut(ruler: Ruler, a: int, limit: int) -> int:
    """Where a piece from ``a`` of at most ``limit`` graphemes ends: after a sentence, before a blank of the first line, or at the limit."""
    b = ruler.ahead(a, max(1, limit))
    window = ruler.text[a:b]
    if limit < 1:
        return b
    for at in range(len(window) - 2, 0, -1):
        if window[at] in ".!?" and window[at + 1] in _SPACE:
            if ruler.byte(a + at + 1) - ruler.byte(a) > max(limit, 2) // 2:
                return a + at + 1
            break
    line = window.find("\n")
    for at in range(len(window) - 1 if line < 0 else line, 0, -1):
        if window[at] in _SPACE:
            return a + at
    return b


def by_characters(ruler: Ruler, span: Span, limit: int, overlap: int) -> list[Span]:
    """Pieces of at most ``limit`` graphemes; a piece starts ``overlap`` graphemes before the last one's end, and moves on by one at least."""
    a, b = span
    out = []
    while ruler.size((a, b)) > limit:
        end = _cut(ruler, a, limit)
        out.append((a, end))
        length = ruler.size((a, end))
        a = ruler.ahead(a, max(1, length - min(overlap, max(0, length - 1))))
    out.append((a, b))
    return out


def sentences(ruler: Ruler, span: Span) -> list[Span]:
    """Sentences: up to ``.``, ``!`` or ``?`` before white space or the end; blanks between are skipped, a rest without end is kept."""
    text, (a, b) = ruler.text, span
    out = []
    for m in _END.finditer(text, a, b):
        while a < m.end() and text[a] in _SPACE:
            a += 1
        if m.end() > a:
            out.append((a, m.end()))
        a = m.end()
    while a < b and text[a] in _SPACE:
        a += 1
    if a < b and text[a:b].strip():
        out.append((a, b))
    return out


def paragraphs(ruler: Ruler) -> list[Span]:
    """Trimmed stretches between two or more line ends; blank ones are dropped."""
    text, out, a = ruler.text, [], 0
    for m in [*_BREAK.finditer(text), None]:
        b = m.start() if m else len(text)
        part = text[a:b]
        if part.strip():
            lead = len(part) - len(part.lstrip())
            out.append((a + lead, a + len(part.rstrip())))
        a = m.end() if m else b
    return out


def _fold(ruler: Ruler, units: list[Span], least: int | None, limit: int, split: Callable[[Span], list[Span]]) -> list[Span]:
    """Join neighbouring units until they have ``least`` graphemes, never above ``limit``; units above it are split and their rest goes on."""
    queue = list(reversed(units))
    out: list[Span] = []
    while queue:
        held: Span | None = None
        while queue:
            unit = queue[-1]
            joined = unit if held is None else (held[0], unit[1])
            size = ruler.size(joined)
            if size > limit and held is not None:
                break
            queue.pop()
            if size > limit:
                first, *rest = split(unit) or [unit]
                queue.extend(reversed(rest))
                held = first
                break
            held = joined
            if least is None or size >= least:
                break
        if held is not None:
            out.append(held)
    return out


def pack_sentences(ruler: Ruler, units: list[Span], least: int | None, limit: int) -> list[Span]:
    return _fold(ruler, units, least, limit, lambda s: by_characters(ruler, s, limit, 0))


@dataclass(frozen=True)
class Chunker:
    """Base: ``spans`` gives (start, end, extra metadata)."""

    name = "base"

    def spans(self, ruler: Ruler) -> list[tuple[int, int, dict[str, str]]]:
        raise NotImplementedError

    def chunk(self, text: str | None) -> list[dict]:
        """Chunks (content, start_byte, end_byte, index, metadata) of a text; None has none."""
        if text is None:
            return []
        ruler = Ruler(text)
        return [
            {"content": text[a:b], "start_byte": ruler.byte(a), "end_byte": ruler.byte(b), "index": n, "metadata": {"chunker": self.name, **more}}
            for n, (a, b, more) in enumerate(self.spans(ruler))
        ]


@dataclass(frozen=True)
class Character(Chunker):
    """Pieces by size with overlap; an empty text is one empty chunk."""

    max_chars: int = 500
    overlap: int = 50
    name = "character"

    def spans(self, ruler):
        return [(a, b, {}) for a, b in by_characters(ruler, (0, len(ruler.text)), self.max_chars, self.overlap)]


@dataclass(frozen=True)
class Sentence(Chunker):
    """A chunk a sentence; with ``min_chars`` sentences are joined up to it.  An empty text has no chunk."""

    max_chars: int = 500
    min_chars: int | None = None
    name = "sentence"

    def spans(self, ruler):
        return [(a, b, {}) for a, b in pack_sentences(ruler, sentences(ruler, (0, len(ruler.text))), self.min_chars, self.max_chars)]


@dataclass(frozen=True)
class Paragraph(Chunker):
    """A chunk a paragraph; oversized ones are cut at sentences, short ones joined up to ``min_chars``.  An empty text has no chunk."""

    max_chars: int = 500
    min_chars: int | None = None
    name = "paragraph"

    def spans(self, ruler):
        cut = lambda s: pack_sentences(ruler, sentences(ruler, s), self.min_chars, self.max_chars)
        units = paragraphs(ruler)
        out: list[Span] = []
        while units:
            first, rest = units[0], units[1:]
            size = ruler.size(first)
            if size > self.max_chars:
                out += cut(first)
                units = rest
            elif self.min_chars is not None and size < self.min_chars and rest:
                joined = first
                while rest and ruler.size(joined) < self.min_chars and ruler.size((first[0], rest[0][1])) <= self.max_chars:
                    joined, rest = (first[0], rest[0][1]), rest[1:]
                out.append(joined)
                units = rest
            else:
                out.append(first)
                units = rest
        return [(a, b, {}) for a, b in out]


@dataclass(frozen=True)
class Recursive(Chunker):
    """Paragraphs, else sentences, else characters; ``hierarchy`` says which.  A blank text is one chunk."""

    max_chars: int = 500
    min_chars: int | None = None
    name = "recursive"

    def spans(self, ruler):
        out = []
        for span in paragraphs(ruler) or [(0, len(ruler.text))]:
            if ruler.size(span) <= self.max_chars:
                out.append((*span, {"hierarchy": "paragraph"}))
                continue
            units = sentences(ruler, span)
            if len(units) > 1:
                out += [(a, b, {"hierarchy": "sentence"}) for a, b in pack_sentences(ruler, units, self.min_chars, self.max_chars)]
            else:
                out += [(a, b, {"hierarchy": "character"}) for a, b in by_characters(ruler, span, self.max_chars, 0)]
        return out


@dataclass(frozen=True)
class Semantic(Chunker):
    """Neighbouring sentences as long as they are similar to the group's running mean and fit; single long sentences stay whole.

    ``embed`` maps a list of texts to vectors; all sentences of a text are embedded in one call.
    """

    embed: Callable[[list[str]], list] | None = None
    threshold: float = 0.8
    max_chars: int = 500
    name = "semantic"

    def spans(self, ruler):
        if self.embed is None:
            raise ValueError("a semantic chunker needs an embedding function")
        units = sentences(ruler, (0, len(ruler.text)))
        if len(units) <= 1:
            return [(a, b, {}) for a, b in units]
        vectors = [np.asarray(v, float) for v in self.embed([ruler.text[a:b] for a, b in units])]
        out: list[Span] = []
        group, mean = units[0], vectors[0]
        for unit, vector in zip(units[1:], vectors[1:]):
            norm = float(np.sqrt(mean @ mean) * np.sqrt(vector @ vector))
            close = norm > 0 and float(mean @ vector) / norm >= self.threshold
            if ruler.size((group[0], unit[1])) <= self.max_chars and (close or norm == 0 and self.threshold <= 0):
                group, mean = (group[0], unit[1]), (mean + vector) / 2
            else:
                out.append(group)
                group, mean = unit, vector
        out.append(group)
        return [(a, b, {}) for a, b in out]


#: Separators by format, the strongest first; a piece keeps the separator it starts with.
FORMATS: dict[str, tuple[str, ...]] = {
    "plaintext": (r"\n\n+", r"\n", r"(?<=[.!?])\s", r"\s"),
    "markdown": (r"(?=\n#{1,6}\s)", r"(?=\n```)", r"\n\n+", r"\n", r"(?<=[.!?])\s", r"\s"),
    "html": (r"(?=<(?:h[1-6]|section|article|div|table|ul|ol)\b)", r"(?=<(?:p|li|tr|br|pre)\b)", r"\n", r"\s"),
    "python": (r"(?=\n(?:class|async def|def)\s)", r"(?=\n\s+(?:async def|def)\s)", r"\n\n+", r"\n", r"\s"),
    "elixir": (r"(?=\n\s*defmodule\s)", r"(?=\n\s*(?:@doc|defp?|defmacrop?)\b)", r"\n\n+", r"\n", r"\s"),
    "javascript": (r"(?=\n(?:export\s|class\s|function\s|const\s))", r"\n\n+", r"\n", r"\s"),
}


@dataclass(frozen=True)
class FormatAware(Chunker):
    """Pieces of at most ``chunk_size`` by the separators of a format, repeating up to ``chunk_overlap`` at whole pieces.

    ``size_fn`` measures a text, by default in graphemes.  An empty text is one empty chunk; an unknown format or
    an overlap that isn't below the size is a ValueError.
    """

    format: str = "plaintext"
    chunk_size: int = 2000
    chunk_overlap: int = 200
    size_fn: Callable[[str], int] | None = field(default=None)
    name = "format_aware"

    def spans(self, ruler):
        if self.format not in FORMATS:
            raise ValueError(f"unknown format {self.format}")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap must be below the size")
        text = ruler.text
        size = (lambda s: ruler.size(s)) if self.size_fn is None else (lambda s: self.size_fn(text[s[0] : s[1]]))
        if not text:
            return [(0, 0, {"format": self.format})]
        return [(a, b, {"format": self.format}) for a, b in self._split(text, (0, len(text)), 0, size)]

    def _split(self, text: str, span: Span, level: int, size: Callable[[Span], int]) -> list[Span]:
        """Pieces of a span: its parts at this level packed up to the size, oversized parts by the next level."""
        if size(span) <= self.chunk_size:
            return [span]
        separators = FORMATS[self.format]
        start, end = span
        if level == len(separators):
            out = []
            while start < end:
                stop = min(end, start + self.chunk_size)
                while stop > start + 1 and size((start, stop)) > self.chunk_size:
                    stop -= 1
                while stop < end and size((start, stop + 1)) <= self.chunk_size:
                    stop += 1
                out.append((start, stop))
                start = stop
            return out
        inner = (start + m.end() for m in re.finditer(separators[level], text[start:end]))
        cuts = [start, *(c for c in inner if start < c < end), end]
        out, held = [], []
        for part in zip(cuts, cuts[1:]):
            if size(part) > self.chunk_size:
                if held:
                    out.append((held[0][0], held[-1][1]))
                    held = []
                out += self._split(text, part, level + 1, size)
                continue
            if held and size((held[0][0], part[1])) > self.chunk_size:
                out.append((held[0][0], held[-1][1]))
                while held and (size((held[0][0], held[-1][1])) > self.chunk_overlap or size((held[0][0], part[1])) > self.chunk_size):
                    held.pop(0)
            held.append(part)
        if held:
            out.append((held[0][0], held[-1][1]))
        return out
