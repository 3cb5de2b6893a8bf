"""Content-defined splitting of oversized texts.

Method: a rolling hash over the last characters marks landmarks that depend on the text alone.
From the last cut the first landmark beyond the minimum size is taken and snapped to the nearest
natural boundary of the text's format between minimum and maximum size.  As landmarks and
boundaries move with the text, an edit alters only the pieces around it.  Every piece but the
first starts with exactly ``overlap`` characters of the one before.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Characters under the rolling hash, and its base.
WINDOW, BASE = 16, 0x9E3779B97F4A7C15
#: Largest table of limits that is held on the driver; more rows raise an error.
MOST_LIMITS = 10_000

_SENTENCE = r"[.!?…]+[\"'”’»)\]]*(?=\s)\s+|[。！？]+[」』）]*\s*"
_BLANK = r"(?:\r\n|\r|\n| | )(?:[^\S\r\n  ]*(?:\r\n|\r|\n| | ))+"
_LINE = r"\r\n|\r|\n| | "
_WORD = r"\s+"

#: Boundaries by format, the most natural first.  A match's end is the place of a cut.
BOUNDARIES: dict[str, tuple[str, ...]] = {
    "markdown": (r"(?:^|(?<=[\r\n]))(?=\#{1,6}\s)", _BLANK, r"(?<=[\r\n])(?=(?:[-*+]|\d{1,3}[.)])\s|\||>|```|~~~)", _LINE, _SENTENCE, _WORD),
    "html": (r"(?i)(?=<(?:h[1-6]|section|article|table|ul|ol|pre)\b)|</(?:section|article|table|ul|ol|pre|div)\s*>\s*", r"(?i)</(?:p|li|tr|h[1-6]|dd|dt|blockquote)\s*>\s*|<(?:br|hr)\s*/?>\s*", _BLANK, _LINE, _SENTENCE, r"\s+(?![^<>]*>)"),
    "elixir": (r"(?<=[\r\n])(?=[ \t]*(?:defmodule|defimpl|defprotocol)\b)", r"(?<=[\r\n])(?=[ \t]*(?:@doc|@spec|@impl|defp?|defmacrop?|test|describe)\b)", _BLANK, r"(?<=[\r\n])[ \t]*end[ \t]*(?:\r\n|\r|\n)", _LINE, _SENTENCE, _WORD),
    "plain": (_BLANK, _LINE, _SENTENCE, _WORD),
}
_FENCE = regex.compile(r"(?m)^[ \t]*(```|~~~)[^\n]*\n(?s:.*?)(?:^[ \t]*\1[ \t]*$|\Z)")
_TAG = regex.compile(r"<[/!?a-zA-Z][^<>]*>")


@lru_cache(maxsize=16)
def _patterns(fmt: str) -> tuple[regex.Pattern, ...]:
    return tuple(regex.compile(p) for p in BOUNDARIES.get(fmt, BOUNDARIES["plain"]))


def boundaries(text: str, fmt: str) -> list[list[int]]:
    """Places of natural cuts by rank; none inside a tag, and inside a fenced block only line ends and blanks."""
    inside: list[tuple[int, int]] = []
    if fmt == "markdown":
        inside = [m.span() for m in _FENCE.finditer(text)]
    elif fmt == "html":
        inside = [m.span() for m in _TAG.finditer(text)]
    starts = [a for a, _ in inside]

    def free(p: int) -> bool:
        k = bisect_left(starts, p) - 1
        return k < 0 or p >= inside[k][1]

    ranks = []
    last = len(_patterns(fmt)) - 1
    for rank, pattern in enumerate(_patterns(fmt)):
        places = [m.end() for m in pattern.finditer(text)]
        if inside and (fmt == "html" or pattern.pattern not in (_LINE, _WORD)):
            places = [p for p in places if free(p)]
        ranks.append(places if rank < last or places else [])
    return ranks


def landmarks(text: str, every: int) -> np.ndarray:
    """Places after which the rolling hash of the last characters has a set form; one in about ``every``."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if len(codes) < WINDOW:
        return np.empty(0, np.int64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(len(codes) - WINDOW + 1, np.uint64)
        for k in range(WINDOW):
            rolled = rolled * np.uint64(BASE) + codes[k : len(codes) - WINDOW + 1 + k]
        rolled ^= rolled >> np.uint64(29)
        rolled *= np.uint64(0xBF58476D1CE4E5B9)
    return np.nonzero((rolled >> np.uint64(20)) % np.uint64(max(1, every)) == 0)[0] + WINDOW


def _whole(text: str, p: int, low: int) -> int:
    """``p`` moved back out of a cluster of characters, if there is room."""
    for q in range(p, max(low, p - 32), -1):
        if q >= len(text) or not _joined(text, q):
            return q
    return p


_JOINER = regex.compile(r"[\p{M}‍︎️\U0001F3FB-\U0001F3FF]")


def _joined(text: str, q: int) -> bool:
    return bool(_JOINER.match(text, q)) or text[q - 1] == "‍" or text[q - 1 : q + 1] == "\r\n" or ("\U0001f1e6" <= text[q] <= "\U0001f1ff" and "\U0001f1e6" <= text[q - 1] <= "\U0001f1ff")


def split_text(text: str | None, fmt: str, max_chars: int, overlap: int = 0, least: int | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) in code points of the pieces of a text.

    A text within the limit is one piece; None and an empty text have none.  The overlap is cut to half
    of the limit at most, so that every piece brings something new.
    """
    if not text:
        return []
    if max_chars < 1:
        raise ValueError("max_chars must be 1 or more")
    n = len(text)
    if n <= max_chars:
        return [(0, n)]
    overlap = max(0, min(overlap, max_chars // 2))
    room = max_chars - overlap
    least = max(1, min(room, least if least is not None else room // 3))
    marks = landmarks(text, max(1, (room - least) // 3))
    ranks = boundaries(text, fmt)
    spans, cut = [], 0
    while True:
        start = max(0, cut - overlap)
        if n - start <= max_chars:
            spans.append((start, n))
            return spans
        low, high = cut + least, cut + room
        k = int(np.searchsorted(marks, low))
        aim = int(marks[k]) if k < len(marks) and marks[k] <= high else high
        place = None
        for places in ranks:
            a, b = bisect_left(places, low), bisect_right(places, high)
            if a < b:
                j = bisect_left(places, aim, a, b)
                place = min((places[x] for x in (j - 1, j) if a <= x < b), key=lambda p: (abs(p - aim), p))
                break
        cut = _whole(text, aim, low) if place is None else place
        spans.append((start, cut))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        for key, fmt, limit, overlap, text in zip(*(c.to_pylist() for c in batch.columns)):
            for n, (a, b) in enumerate(split_text(text, fmt, limit, overlap)):
                for column, value in zip(out, (key, fmt, n, a, b, text[a:b])):
                    column.append(value)
        kinds = (batch.column(0).type, pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds)], names=["id", "fmt", "piece", "start", "end", "text"])


def extension(source: Column) -> Column:
    """Lower-case text after the last dot of the last path part, without query and fragment; null if there is none."""
    part = F.element_at(F.split(F.regexp_replace(source, r"(?s)[?#].*$", ""), "/"), -1)
    return F.when(part.contains("."), F.lower(F.substring_index(part, ".", -1)))


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(id, fmt, max_chars, overlap_chars, content) of every record whose content exceeds its format's limit.

    A record's limit is the row of ``limits`` for the extension of its source, else the row ``other``; without
    either nothing is oversized.  Null contents never are; copies of a record count once.
    """
    rows = limits.select("ext", "fmt", "max_chars", "overlap_chars").where("ext IS NOT NULL AND max_chars > 0").limit(MOST_LIMITS + 1).collect()
    if len(rows) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    if not rows:
        return chunks.select("id", F.lit("").alias("fmt"), F.lit(0).alias("max_chars"), F.lit(0).alias("overlap_chars"), "content").where("false")
    one = lambda r: F.struct(F.lit(r.fmt).alias("fmt"), F.lit(int(r.max_chars)).alias("max_chars"), F.lit(int(r.overlap_chars or 0)).alias("overlap_chars"))
    table = F.create_map(*(x for r in {r.ext: r for r in rows}.values() for x in (F.lit(r.ext), one(r))))
    limit = F.coalesce(F.try_element_at(table, F.coalesce(extension(F.col("source")), F.lit("other"))), F.try_element_at(table, F.lit("other")))
    long_ = chunks.select("id", "content", limit.alias("l")).where(F.length("content") > F.col("l.max_chars"))
    return long_.groupBy("id").agg(F.first("l").alias("l"), F.first("content").alias("content")).select("id", "l.fmt", "l.max_chars", "l.overlap_chars", "content")


def split_oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """Pieces (id, fmt, piece, start, end, text) of every oversized record of ``chunks(id, content, source)``.

    Positions are code points, pieces are numbered from 0.  Only oversized contents leave the scan; extra
    columns are not read; see :func:`oversized` for nulls, copies and empty tables.
    """
    kind = chunks.schema["id"].dataType.simpleString()
    return oversized(chunks, limits).mapInArrow(_pieces, f"id {kind}, fmt string, piece int, start int, end int, text string")


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held: dict[tuple[str, int], int] = {}
        for fmt, limit, overlap, text in zip(*(c.to_pylist() for c in batch.columns)):
            ranks = [set(places) for places in boundaries(text, fmt)]
            for _, cut in split_text(text, fmt, limit, overlap)[:-1]:
                rank = next((n for n, places in enumerate(ranks) if cut in places), -1)
                held[fmt, rank] = held.get((fmt, rank), 0) + 1
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in keys], pa.string()), pa.array([r for _, r in keys], pa.int32()), pa.array([held[k] for k in keys], pa.int64())], names=["fmt", "rank", "n"])


def cut_quality(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(fmt, rank, cuts, share): at which natural boundaries oversized records are cut, 0 for the strongest of the format, -1 for none."""
    found = oversized(chunks, limits).select("fmt", "max_chars", "overlap_chars", "content").mapInArrow(_ranked, "fmt string, rank int, n long").groupBy("fmt", "rank").agg(F.sum("n").alias("cuts"))
    whole = found.groupBy("fmt").agg(F.sum("cuts").alias("all"))  # as many rows as there are formats
    return found.join(whole, "fmt").select("fmt", "rank", "cuts", F.round(F.col("cuts") / F.col("all"), 6).alias("share"))
