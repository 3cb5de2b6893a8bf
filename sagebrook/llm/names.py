"""Variant spellings of the names of persons and organisations.

Method: names are folded and read as an anchor (family name, leading word of an organisation) with its side (given name or initial, line
of business).  All suffixes of the anchors from a least length are indexed and counted.  A suffix of few anchors is a blocking key as it is.
An overly common one is refined with what stands before it, less a letter, and then discarded; so are the suffixes below the least length,
which are common by nature.  A refined key holds a bounded number of anchors, whatever the suffix: those that are equal but for a letter.
Pairs are compared by the longest common subsequence of their anchors and the compatibility of their sides.

Lines of business, their short forms and the given names that may be glued to a family name are learned from the collection: words that
stand behind many different leading words, and words that abbreviate those.

Equal folded names are one form from the start; links hold between forms, and groups are the chains of
links.  A form with a mere initial that fits several given names of one family is linked to none of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sagebrook.operators.components import connected_components
from sagebrook.storage import dropped, small_enough, spread, written

#: Least length of an indexed suffix, and anchors of one suffix above which it is refined.
LEAST_SUFFIX, COMMON = 4, 60
#: Sides of one anchor from which pairs are spread over tasks anew; it decides nothing else.
CROWDED = 60
#: A line of business stands behind this share of all leading words, and three at least; its short forms behind this share, and two.  So
#: the driver gets a few hundred lines and a few thousand short forms, however large the collection.
LINE_SHARE, SHORT_SHARE = 0.003, 0.0005
#: A given name that may be glued occurs in this share of the persons' names, and five at least; in so many it is one of very many people.
GIVEN_SHARE, SHARED = 0.001, 40
#: Largest table of familiar forms that is held on the driver.
MOST_FORMS = 100_000

# Words around the names of persons, of organisations, and within both.
TITLES = frozenset("dr prof rev eng mr mrs ms mx sir dame fr hon herr frau phd msc bsc ceo cto cfo esq".split())
LEGAL = frozenset("gmbh llc corporation corp ag limited ltd company co incorporated inc plc sa kg the and of group".split())
CASUAL = frozenset("team hq headquarters office".split())
PARTICLES = frozenset("van de von der den del della di da du la le el al bin ten ter zu".split())
# Kinds by the spellings of type.
PERSON = ("person", "people", "per", "persons", "human")
ORGANISATION = ("organization", "organisation", "org", "company", "organizations", "organisations", "companies", "corp")
_DIGITS = str.maketrans("01358", "olesb")


def fold(text: str) -> str:
    """Lower case without marks and digraphs of umlauts; white space made plain; digits read as the letters they resemble."""
    text = unicodedata.normalize("NFKD", text.casefold())
    text = "".join(c for c in text if not unicodedata.combining(c)).translate(_DIGITS)
    text = text.replace("ß", "ss").replace("ae", "a").replace("oe", "o").replace("ue", "u")
    return " ".join(text.split())


def _squash(token: str) -> str:
    return re.sub(r"[^a-z]", "", token)


def _read_alike(anchor: str) -> str:
    """An anchor with pairs of letters as the one they are taken for."""
    return anchor.replace("rn", "m").replace("vv", "w")


def read_person(name: str, short: dict[str, str], given: frozenset[str], shared: frozenset[str] = frozenset()) -> list[tuple[str, str]]:
    """Readings (anchor, side) of a person's name; the side is a given name, the start of one, or an initial.

    ``given`` are names that may be glued, ``shared`` those of very many people.
    """
    text = re.sub(r"\([^)]*\)", " ", fold(name))
    handle = " " not in text and ("@" in text or "_" in text or re.fullmatch(r"[a-z'-]+\.[a-z'-]+", text) is not None)
    parts = text.split(",")
    if len([w for w in parts[0].split() if _squash(w) not in PARTICLES and _squash(w) not in TITLES]) > 1:
        parts = parts[:1]  # behind a whole name stands a title or office
    words = [w for p in parts for w in re.split(r"[\s@_]+|(?<=[a-z]{2})\.(?=[a-z]{5})" if not handle else r"[\s@_.]+", p)]
    words = [w for w in (_squash(w) for w in words) if w and w not in TITLES]
    if len(words) > 1:
        words = [w for w in words if w not in PARTICLES] or words
    long_ = [w for w in words if len(w) >= 5]
    rest = [w for w in words if len(w) < 5]
    if not long_:
        long_, rest = (sorted(words, key=len)[-1:], sorted(words, key=len)[:-1]) if words else ([], [])
    out: list[tuple[str, str]] = []
    if len(long_) == 1:
        a = long_[0]
        if rest:
            # A pair of initials stands for given and middle name; a listed short form is a name.
            names = [w for w in rest if len(w) > 2 or w in short]
            out.append((a, names[0] if names else rest[0][0]))
        for g in given:
            if len(a) - len(g) >= 5:
                if a.endswith(g):
                    out.append((a[: -len(g)], g))
                if a.startswith(g):
                    out.append((a[len(g) :], g))
        if not rest and not out:
            out.append((a, ""))
    else:
        for n, a in enumerate(long_):
            for m, s in enumerate(long_):
                if n != m:
                    out.append((a, s))
        if rest and len(long_) > 1 and any(w in short or len(w) > 2 for w in rest):
            out.append(("".join(long_), next(w for w in rest if w in short or len(w) > 2)))
    # A name of very many people leads no one if another word can: they would all meet at it.
    out = [(x, y) for x, y in out if x not in shared] or out
    # A particle may be glued to the family name.
    out += [(a[len(p) :], s) for a, s in out for p in ("van", "de") if a.startswith(p) and len(a) - len(p) >= 6]
    return list(dict.fromkeys(out))


def abbreviates(word: str, line: str) -> bool:
    """Whether a word is shorter than a line, has its first letter and its other letters in order."""
    return 2 <= len(word) < len(line) and word[0] == line[0] and _within(word, line)


class Lines:
    """Lines of business and their short forms, from the words behind leading words: ``counts`` (word, leading words)."""

    def __init__(self, counts: dict[str, int], least: float):
        self.weight: dict[str, int] = {}
        self.short: dict[str, str] = {}
        words = sorted((w for w in counts if w not in LEGAL and w not in CASUAL and w not in PARTICLES), key=lambda w: (-counts[w], w))
        for w in words:
            if counts[w] >= least and len(w) >= 4 and self._fit(w) is None:
                self.weight[w] = counts[w]
        for w in words:
            if w not in self.weight and (line := self._fit(w)) is not None:
                self.short[w] = line
        #: What may be glued to a leading word, longest first: lines and long words of legal forms, then short forms.
        self.ends = sorted([*self.weight, *(w for w in LEGAL if len(w) >= 4), *(w for w in self.short if len(w) >= 4)], key=lambda w: (-len(w), w))

    def _fit(self, word: str) -> str | None:
        """The line that a word abbreviates: one that it begins before others, then the commonest."""
        fits = [f for f in self.weight if abbreviates(word, f)]
        return max(fits, key=lambda f: (f.startswith(word), self.weight[f], f)) if fits else None

    def known(self, word: str) -> str | None:
        """The line that a word means, by its short forms and with one slip; "" for a legal form or casual word."""
        if word in LEGAL or word in CASUAL:
            return ""
        if word in self.weight:
            return word
        found = self.short.get(word) or self.short.get(word.removesuffix("s")) or (self._fit(word) if len(word) <= 6 else None)
        if found or len(word) < 6:
            return found
        for line in self.weight:
            if (line[0] == word[0] or line[1:3] == word[1:3]) and same_anchor(word, line):
                return line
        return "" if any(len(w) >= 7 and same_anchor(word, w) for w in LEGAL) else None

    def slipped(self, word: str) -> str | None:
        """The line that a word of four letters or more means by a short form with one slip."""
        near = [f for f in self.short if len(word) >= 4 and common_subsequence(word, f) >= max(len(word), len(f)) - 1]
        return self.short[min(near)] if near else None


def organisation_words(name: str) -> list[str]:
    """Folded words of an organisation's name, without what stands in brackets."""
    text = re.sub(r"\([^)]*\)", " ", fold(name).replace("&", " and "))
    words = [_squash(w) for w in re.split(r"[\s,/]+|(?<=[a-z])\.(?=[a-z])", text)]
    return [w for w in words if w]


def read_organisation(name: str, lines_: Lines) -> list[tuple[str, str]]:
    """Readings (leading word, lines of business) of an organisation's name; a trailing ``~`` marks a casual form.

    There are several where a short form is glued to the leading word.
    """
    words = organisation_words(name)
    casual = any(w in CASUAL for w in words) or re.search(r"\((?:web|www|online)\)", name.casefold()) is not None
    core, lines = [], []
    for n, w in enumerate(words):
        known = lines_.known(w)
        if n + 1 < len(words) and words[n + 1] == "of" or len(w) > 4 and w.endswith("of") and lines_.known(w[:-2]):
            known = lines_.known(w.removesuffix("of")) or known or lines_.slipped(w)
        if known is not None:
            lines += [known] if known else []
            continue
        stripped = True
        while stripped:
            stripped = False
            for end in lines_.ends:
                if len(w) - len(end) >= 5 and w.endswith(end) and (end in lines_.weight or end in LEGAL):
                    w, stripped = w[: -len(end)], True
                    if end in lines_.weight:
                        lines.append(end)
                    break
        if w not in PARTICLES or len(words) == 1:
            core.append(w)
    if any(len(w) >= 5 for w in core):
        core = [w for w in core if len(w) > 3]
    if not core:
        # A name of nothing but such words is led by the first of them.
        if not words:
            return []
        core = words[:1]
    mark = "~" if casual else ""
    whole = "".join(core)
    out = [(whole, "+".join(sorted(set(lines))) + mark)]
    for part, more in ((whole, lines), *((whole[len(p) :], lines) for p in ("van", "de") if whole.startswith(p) and len(whole) - len(p) >= 6)):
        if part != whole:
            out.append((part, "+".join(sorted(set(more))) + mark))
        for short, line in lines_.short.items():
            if not more or casual or len(short) >= 4:
                for end in (short, short + "s"):
                    if len(part) - len(end) >= 6 and part.endswith(end):
                        out.append((part[: -len(end)], "+".join(sorted({*more, line})) + mark))
    return list(dict.fromkeys(out))


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for n, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << n)
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def same_anchor(a: str, b: str) -> bool:
    """Whether the ratio of the common subsequence to the longer anchor leaves one slip, two from 16 letters."""
    if a == b or _read_alike(a) == _read_alike(b):
        return True
    longer = max(len(a), len(b))
    return longer >= 5 and common_subsequence(a, b) / longer >= 1 - (2 if longer >= 16 else 1) / longer - 1e-9


def _less(text: str) -> set[str]:
    return {text[:n] + text[n + 1 :] for n in range(len(text))}


def refined_keys(a: str, least: int) -> set[str]:
    """Keys of an anchor whose suffixes below length ``least`` are common: with what stands before them, less a letter.

    The letter goes just before each such suffix, and one farther for letters that changed places; from 14 letters one more goes
    before it, for anchors with two slips.
    """
    keys = {a, "=" + _read_alike(a)}
    for n in range(min(len(a) - 1, least) + 1):
        cut = len(a) - n
        keys.add(a[: cut - 1] + a[cut:])
        if len(a) >= 14:
            keys |= {h + a[cut:] for h in _less(a[: cut - 1])} | {h + a[cut:] for h in _less(a[:cut])}
    return keys


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 2000):
            part = batch.slice(at, 2000)
            keys = [sorted(refined_keys(a, n)) for a, n in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            rows = part.take(pa.array([n for n, k in enumerate(keys) for _ in k], pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], pa.array([x for k in keys for x in k], pa.string())], names=["kind", "a", "key"])


def blocking_keys(anchors: DataFrame) -> DataFrame:
    """(kind, a, key, bare): blocking keys of anchors (kind, a): ``bare`` suffixes of few anchors, and refined ones.

    Two anchors with one letter more, less, other or changed places with its neighbour share a key, wherever the letter is.
    """
    least = F.least(F.lit(LEAST_SUFFIX), F.length("a"))
    suffixes = F.transform(F.sequence(F.lit(1), F.length("a") - least + 1), lambda n: F.substr(F.col("a"), n))
    indexed = written(anchors.select("kind", "a", F.explode(suffixes).alias("suffix")), "suffixes")
    common = written(indexed.groupBy("kind", "suffix").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("kind", "suffix"), "common")
    if small_enough(common.count(), 32):
        few = indexed.join(F.broadcast(common), ["kind", "suffix"], "left_anti")
    else:
        few = indexed.join(common, ["kind", "suffix"], "left_anti")
    few = written(few, "few")
    # Suffixes of an anchor below its shortest one of few anchors are common or too short.
    shortest = few.groupBy("kind", "a").agg(F.min(F.length("suffix")).alias("least"))
    bounded = anchors.join(shortest, ["kind", "a"], "left").select("kind", "a", F.coalesce("least", F.length("a")).cast("int").alias("least"))
    refined = spread(bounded).mapInArrow(_refined, "kind string, a string, key string").select("kind", "a", F.xxhash64("kind", F.lit("refined"), "key").alias("key"), F.lit(False).alias("bare"))
    # What share a longer suffix share the shortest one too, which is that of both.
    bare = shortest.select("kind", "a", F.xxhash64("kind", F.expr("right(a, least)")).alias("key"), F.lit(True).alias("bare"))
    keys = written(bare.unionByName(refined), "keys")
    for table in (indexed, common, few):
        dropped(table)
    return keys


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([same_anchor(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())], pa.bool_()))


def _within(short: str, long_: str) -> bool:
    it = iter(long_)
    return all(c in it for c in short)


def same_given(a: str, b: str, short: dict[str, str]) -> bool:
    """Whether two given names, initials, starts or familiar forms may be one person's."""
    if a == b:
        return True
    if not a or not b:
        return False
    full_a, full_b = short.get(a, a), short.get(b, b)
    if full_a == full_b:
        return True
    if len(a) == 1 or len(b) == 1:
        return (a[0] == b[0]) or full_a[0] == full_b[0]
    if a in short and b in short:
        return False
    for x, y in ((a, full_b), (b, full_a), (full_a, full_b)):
        x, y = (x, y) if len(x) <= len(y) else (y, x)
        if x[0] == y[0] and _within(x, y) and (len(x) <= 4 or len(y) - len(x) <= 1):
            return True
    longer = max(len(full_a), len(full_b))
    return longer >= 4 and common_subsequence(full_a, full_b) / longer >= 1 - 1 / longer - 1e-9


def same_lines(a: str, b: str) -> bool:
    """Whether two sets of lines of business may be one organisation's: equal, or a casual form that leaves some out."""
    casual = a.endswith("~") or b.endswith("~")
    x, y = set(a.rstrip("~").split("+")), set(b.rstrip("~").split("+"))
    return x == y or (casual and (x <= y or y <= x or x == {""} or y == {""}))


def _led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leading word, word behind it) of organisations' names; where ``of`` follows a word, that stands behind the next."""
    for batch in batches:
        out: list[tuple[str, str]] = []
        for name in batch.column(0).to_pylist():
            words = organisation_words(name)
            if len(words) > 2 and words[1] == "of":
                words = [words[2], words[0], *words[3:]]
            words = words[1:] if words[:1] == ["the"] else words
            out += [(words[0], w) for w in dict.fromkeys(words[1:]) if w != words[0]]
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], names=["first", "word"])


def learned_lines(plain: DataFrame) -> Lines:
    """Lines of business and short forms of the organisations' names in the first column."""
    pairs = written(plain.mapInArrow(_led, "first string, word string").distinct(), "led")
    leading = pairs.select("first").distinct().count()
    counts = pairs.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= max(2.0, SHORT_SHARE * leading)).collect()
    dropped(pairs)
    return Lines({r.word: r.n for r in counts}, max(3.0, LINE_SHARE * leading))


def _readings(short: dict[str, str], given: frozenset[str], shared: frozenset[str], lines: Lines):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for form, kind, name in zip(*(c.to_pylist() for c in batch.columns)):
                found = read_person(name, short, given, shared) if kind == "p" else read_organisation(name, lines)
                for a, s in found:
                    for column, value in zip(out, (form, kind, a, s)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])], names=["form", "kind", "a", "s"])

    return run


def _agree(short: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits = lru_cache(1 << 17)(lambda kind, s, t: same_given(s, t, short) if kind == "p" else same_lines(s, t))
        for batch in batches:
            kind, _, _, s, t = (c.to_pylist() for c in batch.columns)
            yield batch.filter(pa.array(list(map(fits, kind, s, t)), pa.bool_()))

    return run


def kind_of(type_: Column) -> Column:
    """``p`` for the spellings of person, ``o`` for those of organisation, else null."""
    plain = F.lower(F.regexp_replace(type_, r"^[\s ]+|[\s ]+$", ""))
    return F.when(plain.isin(*PERSON), "p").when(plain.isin(*ORGANISATION), "o")


def name_links(entities: DataFrame, forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forms of names and links between them.

    ``entities(id, type, name)``, ``forms(given, short_form)``.  Returns ``members(id, kind, form)`` and
    ``links(a, b)`` between forms.  Null and blank names, other types and null ids are in no form; copies of a record
    count once; empty tables give no rows; a short form of several given names is read as the first by alphabet.
    """
    rows = forms.select("given", "short_form").where("given IS NOT NULL AND short_form IS NOT NULL").limit(MOST_FORMS + 1).collect()
    if len(rows) > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} familiar forms")
    short = {_squash(fold(r.short_form)): _squash(fold(r.given)) for r in sorted(rows, key=lambda r: r.given, reverse=True)}
    parted = F.regexp_replace("name", r"(?<=\p{Ll})(?=\p{Lu}\p{Ll}*\.|\p{Lu}{2,}\b)", " ")  # a short form glued to the word before
    plain = F.regexp_replace(F.regexp_replace(F.lower(parted), r"[\s ]+", " "), r"^ | $", "")
    named = entities.select("id", kind_of(F.col("type")).alias("kind"), plain.alias("plain")).where("id IS NOT NULL AND kind IS NOT NULL AND plain <> ''")
    members = written(named.select("id", "kind", "plain", F.xxhash64("kind", "plain").alias("form")).distinct(), "members")
    distinct = written(members.select("form", "kind", "plain").distinct(), "forms")
    # Given names that many forms share, to part glued names: at most 1 / GIVEN_SHARE times the words of a name.
    persons = distinct.where("kind = 'p'")
    people = persons.count()
    tokens = persons.select(F.explode(F.array_distinct(F.split("plain", r"[^\p{L}]+"))).alias("w")).where(F.length("w") >= 3)
    frequent = tokens.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= max(5.0, GIVEN_SHARE * people)).collect()
    given = frozenset(x for x in {*(_squash(fold(r.w)) for r in frequent), *short.values()} if 3 <= len(x) and x not in TITLES and x not in PARTICLES)
    shared = frozenset(_squash(fold(r.w)) for r in frequent if r.n >= max(SHARED, GIVEN_SHARE * people))
    lines = learned_lines(spread(distinct.where("kind = 'o'").select("plain")))
    readings = written(spread(distinct.select("form", "kind", "plain")).mapInArrow(_readings(short, given, shared, lines), "form long, kind string, a string, s string"), "readings")
    sides = written(readings.select("kind", "a", "s").distinct(), "sides")
    keyed = blocking_keys(written(sides.select("kind", "a").where("a <> ''").distinct(), "anchors")).select("kind", "a", "key").distinct()
    near = keyed.join(keyed.select("key", F.col("kind").alias("other"), F.col("a").alias("b")), "key").where("kind = other AND a < b").select("kind", "a", "b").distinct()
    # The common subsequence bounds the difference of the lengths and, but for letters read alike, the number of edits.
    longer, plain_ = F.greatest(F.length("a"), F.length("b")), lambda c: F.replace(F.replace(F.col(c), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    edits = F.when(longer >= 16, (F.abs(F.length("a") - F.length("b")) <= 2) & (F.levenshtein("a", "b", 4) >= 0)).otherwise((F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 2) >= 0))
    near = near.where(edits | (plain_("a") == plain_("b")))
    alike = near.mapInArrow(_alike, "kind string, a string, b string").union(sides.select("kind", "a", F.col("a").alias("b")).distinct())
    met = alike.join(sides, ["kind", "a"]).join(sides.select("kind", F.col("a").alias("b"), F.col("s").alias("t")), ["kind", "b"]).where("a < b OR s <= t").select("kind", "a", "b", "s", "t")
    if sides.groupBy("kind", "a").count().where(F.col("count") > CROWDED).limit(1).count():
        met = met.repartition("kind", "a", "b", "s", "t")
    fit = met.mapInArrow(_agree(short), "kind string, a string, b string, s string, t string")
    ends = fit.join(readings, ["kind", "a", "s"]).join(readings.select(F.col("form").alias("other"), "kind", F.col("a").alias("b"), F.col("s").alias("t")), ["kind", "b", "t"]).where("form <> other")
    turned = F.col("form") > F.col("other")
    ordered = ends.select(F.least("form", "other").alias("form"), F.greatest("form", "other").alias("other"), "kind", F.when(turned, F.col("t")).otherwise(F.col("s")).alias("s"), F.when(turned, F.col("s")).otherwise(F.col("t")).alias("t"))
    agreed = written(ordered.distinct(), "agreed")
    # A mere initial that meets several people, apart by all that is clear, says nothing.
    clear = written(agreed.where("kind = 'o' OR (length(s) = 1) = (length(t) = 1)").select(F.col("form").alias("a"), F.col("other").alias("b")).distinct(), "clear")
    people = connected_components(clear).select(F.col("id").alias("b"), "component")
    one = agreed.where("kind = 'p' AND length(s) = 1 AND length(t) > 1").select(F.col("form").alias("a"), F.col("other").alias("b"), F.col("t").alias("g"))
    two = agreed.where("kind = 'p' AND length(t) = 1 AND length(s) > 1").select(F.col("other").alias("a"), F.col("form").alias("b"), F.col("s").alias("g"))
    mere = written(one.union(two).distinct().join(people, "b", "left").select("a", "b", F.coalesce("component", "b").alias("person"), F.substring("g", 1, 2).alias("g")), "mere")
    vague = mere.groupBy("a").agg(F.min("person").alias("x"), F.max("person").alias("y"), F.min("g").alias("v"), F.max("g").alias("w")).where("x <> y AND v <> w").select("a")
    links = written(clear.union(mere.join(vague, "a", "left_anti").select("a", "b")).distinct(), "links")
    for table in (distinct, readings, sides, agreed, clear, mere):
        dropped(table)
    return members.select("id", "kind", "form"), links


def name_groups(entities: DataFrame, forms: DataFrame) -> DataFrame:
    """One row an entity: (id, kind, group_id, links); group_id is the smallest id of the group, links the forms linked to its own."""
    members, links = name_links(entities, forms)
    found = connected_components(links)
    degree = links.select(F.col("a").alias("form")).union(links.select(F.col("b").alias("form"))).groupBy("form").agg(F.count("*").alias("links"))
    placed = written(members.join(found.select(F.col("id").alias("form"), "component"), "form", "left").select("id", "kind", "form", F.coalesce("component", "form").alias("c")), "placed")
    heads = placed.groupBy("c").agg(F.min("id").alias("group_id"))
    return placed.join(heads, "c").join(degree, "form", "left").select("id", "kind", "group_id", F.coalesce("links", F.lit(0)).alias("links"))


def name_pairs(entities: DataFrame, forms: DataFrame) -> DataFrame:
    """All pairs (id_a, id_b) of entities of one group."""
    groups = written(name_groups(entities, forms).select("id", "group_id"), "groups")
    return groups.join(groups.select(F.col("id").alias("id_b"), F.col("group_id").alias("g")), F.col("group_id") == F.col("g")).where("id < id_b").select(F.col("id").alias("id_a"), "id_b").distinct()
