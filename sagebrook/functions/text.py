"""Expressions on texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that full-text search leaves out.
STOP_WORDS = (
    "i me my we our ours you your he him his she her it its they them their what which who this that these those am is are was were be been being "
    "have has had do does did a an the and but if or because as until while of at by for with about against between into through during before after "
    "above below to from up down in out on off over under again then once here there when where why how all any both each few more most other some "
    "such no nor not only own same so than too very s t can will just don should now"
).split()


def graphemes(text: Column) -> Column:
    """Number of grapheme clusters."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?s)(\X)"), 1))


def terms(text: Column, stop: bool = False, stem: bool = False) -> Column:
    """Lower-case runs of letters and digits; optionally without stop words, with plural and verb endings cut."""
    out = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    if stop:
        out = F.filter(out, lambda x: ~x.isin(STOP_WORDS))
    if stem:
        out = F.transform(out, lambda x: F.when(F.length(x) > 4, F.regexp_replace(x, "(?:ing|ed|es|s)$", "")).otherwise(x))
    return out


def without_fence(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def line_slice(text: Column, start: int | None = None, end: int | None = None) -> Column:
    """Lines ``start`` to ``end``, both included and counted from 1."""
    lines = F.split(text, "\n")
    first = max(1, start or 1)
    count = F.size(lines) if end is None else F.lit(max(0, end - first + 1))
    return F.array_join(F.slice(lines, F.lit(first), count), "\n")


def rendered(template: str, **values: Column) -> Column:
    """A template with ``{name}`` replaced by columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def token_estimate(text: Column) -> Column:
    """Tokens of a conversation's contents: a quarter of their characters, rounded down; an aggregate."""
    return F.floor(F.coalesce(F.sum(F.length(text)), F.lit(0)) / 4).cast("long")
