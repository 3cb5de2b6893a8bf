"""Statistics of texts that tell prose from lists, tables and junk.

Method: a text's words, symbols and lines give its statistics, none of which names a kind; a Gaussian mixture is fitted to all
standardised texts by expectation-maximisation, in rounds of sums over the whole collection.  It starts at spread-out rows of a bounded
sample.  After the fit a component has the kinds of the labelled examples that it explains, and a text the kind of its components.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebrook.llm.examples import EXAMPLES, INSPECTED
from sagebrook.storage import spread, written

#: Statistics, in order; shares and ratios lie between 0 and 1.  Those of lines are weighted by their length where they are ``mid`` (the
#: median) or ``low`` (the lower quartile).
STATISTICS = (
    "words", "word_length", "symbol_ratio", "digit_ratio", "ended_lines", "common_words", "distinct_words", "line_words", "line_words_sd", "compressed",
    "rare_letters", "broken_ratio", "marked_lines", "kana_ratio", "even_cells", "cells", "commas", "uppercase", "mixed_tokens", "longest", "vowels", "repeated_lines",
    "mid_common", "low_common", "mid_words", "low_words", "stops", "colons", "slashes", "breaks", "capital_lines", "short_words", "ended_chars", "lines", "spaces",
    "longest_line", "repeated_pairs",
)
#: Counts enter the fit as logarithms, ratios that are mostly near 0 as square roots, the others as they are.
_LOGS = ("words", "line_words", "cells", "longest", "mid_words", "low_words", "lines", "longest_line")
_ROOTS = ("symbol_ratio", "digit_ratio", "rare_letters", "broken_ratio", "kana_ratio", "commas", "uppercase", "mixed_tokens", "stops", "colons", "slashes", "breaks")
#: Components, rounds of the fit, rows of the sample that the components start at, largest standardised value.
COMPONENTS, ROUNDS, SAMPLE, FARTHEST = 96, 8, 4096, 6.0
#: Variance that a component starts with, the most a parted one has, the rows that the first weighs, and what is added to every variance.
START_VARIANCE, PARTED_VARIANCE, START_ROWS, LEAST_VARIANCE = 0.3, 0.1, 5.0, 0.02

# Common words of five languages.
COMMON = frozenset(
    "the of and to in a is that it was for on with as by at from this be are an or not if when which had been has no its so than then there what how where why who "
    "should you can your only have did do does after before unless although because since until while whenever once between behind under over during without about "
    "we they he she their our more most some several every each both other another two one any all said up will would could may might into out very also but "
    "der die das und ist nicht ein eine einen einem einer den dem des mit zu zum zur von für auf im in wird werden wenn hat haben es er sie sich bei ohne nach aus als war waren sind sondern dann dass wie noch nur über vor seit um "
    "le la les un une et est que qui dans pour pas sur au aux du de des ne se ce cette avec plus si il elle ils ont sans après avant depuis mais par sont était toute tout "
    "el los las una unos del en por con no es al lo su sus se para cuando como más ha sin había y pero sino muy entonces después antes desde son está toda todo".split()
)
_WORDS = re.compile(r"[^\W\d_]+")
_KANA = re.compile(r"[぀-ヿ]")
_MARK = re.compile(r"[^\w\s\"'“«(¿¡]|\(?\d{1,4}[.):\]]|\d{1,4} - |\(?[a-zA-Z][.)] ")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_MIXED = re.compile(r"[a-z][A-Z]|[A-Za-z]\d|\d[A-Za-z]|[^\w\s.,:;!?'\"()\-/–]{2,}")
_BROKEN = re.compile(r"�|Ã[\x80-ÿ€-™]|Â[\x80-¿]|[\x00-\x08\x0e-\x1f\x7f-\x9f]")
#: What may part the cells of a line, besides wide gaps and commas without a space.
_PARTS = ("|", "\t", ";", "&", "</t")
_STOPS, _BREAKS, _VOWELS = ".!?…。！？", ",;|·•»>→/", "aeiouyAEIOUYäöüáéíóúàèâêîôû"
_ENDS = frozenset(_STOPS + "\"”»:")


def _quantile(values: list[float], weights: list[int], share: float) -> float:
    """The value at a share of the total weight."""
    left = sum(weights) * share
    for k in sorted(range(len(values)), key=values.__getitem__):
        left -= weights[k]
        if left <= 0:
            return values[k]
    return max(values)


def _evenness(lines: list[str], sizes: list[int], text: str) -> tuple[float, int]:
    """Share of the characters in lines with the commonest number of one separator, and that number; of the separators the most even."""
    best = (0.0, 0)
    counts = [[x.count(p) for x in lines] for p in _PARTS if p in text]
    if "," in text:
        counts.append([x.count(",") - x.count(", ") for x in lines])
    if "  " in text:
        counts.append([len(_GAP.findall(x)) if "  " in x else 0 for x in lines])
    for own in counts:
        held: dict[int, int] = {}
        for c, size in zip(own, sizes):
            if c > 0:
                held[c] = held.get(c, 0) + size
        if held:
            c = max(held, key=lambda c: (held[c], c))
            if own.count(c) >= 2:
                best = max(best, (held[c] / sum(sizes), c))
    return best


def statistics(text: str) -> list[float]:
    """The statistics of a text that is not blank, whole."""
    total, plain = len(text), text.isascii()
    raw = text.encode("utf-8", "surrogatepass")
    held = np.bincount(np.frombuffer(raw, np.uint8), minlength=128).tolist()  # bytes below 128 are characters
    lines = [x.strip() for x in text.splitlines() if x and not x.isspace()]
    sizes = list(map(len, lines))
    own = [_WORDS.findall(x.lower()) for x in lines]
    counts = list(map(len, own))
    found = [w for x in own for w in x] if len(own) > 1 else own[0]
    widths = np.fromiter(map(len, found), np.int64, len(found))
    n, letters, tokens = len(found), int(widths.sum()), text.split()
    ink = sum(map(len, tokens))
    kana = 0 if plain else len(_KANA.findall(text))
    digits = sum(held[48:58])
    common = [sum(map(COMMON.__contains__, x)) for x in own]
    shares = [min(1.0, (c / k if k else 0.0) + (len(_KANA.findall(x)) / len(x) if kana else 0.0)) for c, k, x in zip(common, counts, lines)]
    logs = np.log1p(counts)
    even, cells = _evenness(lines, sizes, text)
    ended = [x[-1] in _ENDS for x in lines]
    pairs = max(0, n - 1)
    marks = lambda chars: sum(held[ord(c)] if c < "\x80" else 0 if plain else text.count(c) for c in chars)
    by_token = lambda k: min(1.0, k / len(tokens))
    by_letter = lambda k: min(1.0, k / letters) if letters else 0.0
    return [
        float(n), min(25.0, letters / n) if n else 0.0, max(0, ink - letters - digits) / ink, digits / ink, sum(ended) / len(lines), min(1.0, (sum(common) + kana / 3) / n) if n else 0.0,
        len(set(found)) / n**0.8 if n else 0.0, float(np.expm1(logs.mean())), float(logs.std()), min(1.2, len(zlib.compress(raw, 1)) / len(raw)),
        by_letter(marks("qxzjwvkQXZJWVK")), 0.0 if plain else min(1.0, len(_BROKEN.findall(text)) / total * 5), sum(_MARK.match(x) is not None for x in lines) / len(lines),
        min(1.0, kana / ink * 2), even, float(cells), by_token(held[44]), by_letter(sum(held[65:91])), by_token(len(_MIXED.findall(text))),
        float(max(map(len, tokens))), by_letter(marks(_VOWELS)), 1 - len(set(lines)) / len(lines), _quantile(shares, sizes, 0.5), _quantile(shares, sizes, 0.25),
        float(_quantile(counts, sizes, 0.5)), float(_quantile(counts, sizes, 0.25)), by_token(marks(_STOPS)), by_token(held[58]), by_token(marks("/_=")),
        by_token(marks(_BREAKS)), sum(x[0].isupper() for x in lines) / len(lines), int((widths <= 3).sum()) / n if n else 0.0, sum(s for s, e in zip(sizes, ended) if e) / sum(sizes),
        float(len(lines)), 1 - ink / total, float(max(counts)), 1 - len(set(zip(found, found[1:]))) / pairs if pairs else 0.0,
    ]


def _measured(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t) if t and not t.isspace() else None for t in batch.column(keep).to_pylist()]
            at = np.array([r is not None for r in rows], bool)
            values = np.zeros((len(rows), len(STATISTICS)))
            if at.any():
                values[at] = [r for r in rows if r is not None]
            columns = [pa.array(values[:, k]) for k in range(values.shape[1])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(at), *columns], names=[*batch.schema.names[:keep], "written", *STATISTICS])

    return run


def text_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, written, statistics...) of every row, in one narrow pass.

    ``written`` is false for null, empty and blank texts, whose statistics are 0.  Texts are read whole; repeated
    rows are kept; extra columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, written boolean, " + ", ".join(f"{s} double" for s in STATISTICS)
    return spread(docs.select(key, F.col(text).alias("__text"))).mapInArrow(_measured(1), schema)


@dataclass
class Mixture:
    """A Gaussian mixture with diagonal covariances over standardised statistics; ``kinds`` has a component's share of each kind."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    kinds: np.ndarray | None = None
    names: tuple[str, ...] = ()

    def standardised(self, x: np.ndarray) -> np.ndarray:
        """Rows of the statistics as they enter the fit."""
        return np.clip((_transformed(x) - self.centre) / self.scale, -FARTHEST, FARTHEST)

    def densities(self, z: np.ndarray) -> np.ndarray:
        """Logarithm of every component's density at standardised rows, without what all have in common."""
        square = (z * z) @ (1 / self.variances).T - 2 * z @ (self.means / self.variances).T + (self.means**2 / self.variances).sum(axis=1)
        return -0.5 * (np.log(self.variances).sum(axis=1) + square)

    def responsibilities(self, z: np.ndarray) -> np.ndarray:
        """Probability of every component for standardised rows."""
        log = np.log(self.weights) + self.densities(z)
        p = np.exp(log - log.max(axis=1, keepdims=True)) if len(log) else log
        return p / p.sum(axis=1, keepdims=True)


def _transformed(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for k, name in enumerate(STATISTICS):
        if name in _LOGS:
            x[:, k] = np.log1p(x[:, k])
        elif name in _ROOTS:
            x[:, k] = np.sqrt(x[:, k])
    return x


def _examples() -> tuple[np.ndarray, np.ndarray, tuple[str, ...]]:
    """(statistics, share of each kind, names of the kinds) of the labelled examples."""
    every = [(kind, t) for kind, texts in EXAMPLES.values() for t in texts] + INSPECTED
    names = tuple(sorted({kind for kind, _ in every}))
    return np.array([statistics(t) for _, t in every]), np.array([[kind == n for n in names] for kind, _ in every], float), names


def _block(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(s)) for s in STATISTICS]) if len(batch) else np.empty((0, len(STATISTICS)))


def _totals(batches: Iterator[np.ndarray], width: int) -> pa.RecordBatch:
    total = sum(batches, np.zeros((1, width)))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.FixedSizeListArray.from_arrays(pa.array(total.ravel()), width).cast(pa.list_(pa.float64()))], names=["k", "c"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = (_transformed(_block(b)) for b in batches)
    yield _totals((np.hstack([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])[None, :] for x in rows), 2 * len(STATISTICS) + 1)


def _expected(mixture: Mixture, z: np.ndarray) -> np.ndarray:
    """Sums of one round: rows, values and squares of each component."""
    p = mixture.responsibilities(z)
    return np.hstack([p.sum(axis=0)[:, None], p.T @ z, p.T @ (z * z)])


def _sums(mixture: Mixture):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _totals((_expected(mixture, mixture.standardised(_block(b))) for b in batches), 2 * len(STATISTICS) + 1)

    return run


def _added(rows: DataFrame, function) -> np.ndarray:
    """The sums of all partitions; the driver gets one row a partition sum and component, added up before."""
    width = 2 * len(STATISTICS) + 1
    parts = rows.mapInArrow(function, "k long, c array<double>").select("k", F.posexplode("c").alias("at", "v")).groupBy("k", "at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((max((r.k for r in parts), default=0) + 1, width))
    for r in parts:
        out[r.k, r.at] = r.v
    return out


def _starts(z: np.ndarray, count: int) -> np.ndarray:
    """Means to start at: rows drawn far from those drawn before, then each the mean of the rows nearest to it, ten times."""
    rng = np.random.default_rng(1)
    means = z[[rng.integers(len(z))]]
    away = ((z - means[0]) ** 2).sum(axis=1)
    while len(means) < count and away.max() > 1e-9:
        means = np.vstack([means, z[rng.choice(len(z), p=away / away.sum())]])
        away = np.minimum(away, ((z - means[-1]) ** 2).sum(axis=1))
    for _ in range(10):
        home = ((means**2).sum(axis=1) - 2 * z @ means.T).argmin(axis=1)
        means = np.stack([z[home == k].mean(axis=0) if (home == k).any() else m for k, m in enumerate(means)])
    return means


def _nearest(z: np.ndarray, share: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Kinds of the labelled rows nearest to ``means``, in the metric of the labelled rows' variances within their kinds."""
    within = z - share @ ((share.T @ z) / share.sum(axis=0)[:, None])
    weight = 1 / ((within * within).mean(axis=0) + LEAST_VARIANCE)
    away = (z * z) @ weight - 2 * means @ (z * weight).T
    return share[away.argmin(axis=1)]


def _parted(mixture: Mixture, z: np.ndarray, share: np.ndarray) -> None:
    """Part every component that explains examples of several kinds: one a kind, at the mean of its examples."""
    p = mixture.responsibilities(z)
    votes = p.T @ share
    clear = votes >= np.maximum(0.5, 0.1 * votes.sum(axis=1, keepdims=True))
    mixed = np.nonzero(clear.sum(axis=1) > 1)[0]
    if not len(mixed):
        return
    k, kind = np.nonzero(clear[mixed])
    k = mixed[k]
    part = p[:, k] * share[:, kind]
    rest = np.setdiff1d(np.arange(len(mixture.weights)), mixed)
    mixture.means = np.vstack([mixture.means[rest], (part.T @ z) / part.sum(axis=0)[:, None]])
    mixture.variances = np.vstack([mixture.variances[rest], np.minimum(mixture.variances[k], PARTED_VARIANCE)])
    mixture.weights = np.append(mixture.weights[rest], mixture.weights[k] / clear[k].sum(axis=1))


def fit_mixture(stats: DataFrame, key: str, components: int = COMPONENTS, rounds: int = ROUNDS, sample: int = SAMPLE) -> Mixture:
    """Fit to all written rows and the examples; the driver gets one row of sums a component and round.

    Halfway, components that explain examples of several kinds are parted.  Only where the components start depends on a sample, ``sample`` rows by the hash of the key; the sums of every round are over all rows.
    """
    rows = stats.where("written").select(*STATISTICS)
    labelled, share, names = _examples()
    few = stats.where("written").orderBy(F.xxhash64(key), key).limit(sample).select(*STATISTICS).collect()
    own = _transformed(labelled)
    d = len(STATISTICS)
    total = _added(rows, _moments)[0] + np.hstack([len(own), own.sum(axis=0), (own**2).sum(axis=0)])
    centre = total[1 : d + 1] / total[0]
    scale = np.sqrt(np.maximum(0.0, total[d + 1 :] / total[0] - centre**2)) + 1e-3
    mixture = Mixture(centre, scale, np.empty(0), np.empty(0), np.empty(0), None, names)
    z = mixture.standardised(labelled)
    means = _starts(np.vstack([mixture.standardised(np.array(few, float)), z]) if few else z, components)
    k = len(means)
    mixture.weights, mixture.means, mixture.variances = np.full(k, 1 / k), means, np.full((k, d), START_VARIANCE)
    for turn in range(rounds):
        if turn in (rounds // 4, rounds // 2):
            _parted(mixture, z, share)
            k = len(mixture.weights)
        sums = _added(rows, _sums(mixture))
        sums = (sums if len(sums) == k else np.zeros((k, 2 * d + 1))) + _expected(mixture, z)
        n = sums[:, :1]
        mean = np.where(n > 1e-3, sums[:, 1 : d + 1] / np.maximum(n, 1e-9), mixture.means)
        variance = np.maximum(0.0, sums[:, d + 1 :] / np.maximum(n, 1e-9) - mean**2)
        mixture.means, mixture.variances = mean, (variance * n + START_ROWS * START_VARIANCE) / (n + START_ROWS) + LEAST_VARIANCE
        mixture.weights = (n[:, 0] + 0.5) / (n + 0.5).sum()
    # A component that explains no example has the kind of the one nearest to its mean.
    votes = mixture.responsibilities(z).T @ share
    nearest = _nearest(z, share, mixture.means)
    explained = votes.sum(axis=1, keepdims=True)
    mixture.kinds = np.where(explained >= 0.2, votes / np.maximum(explained, 1e-9), nearest)
    return mixture


def _named(mixture: Mixture):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column("written").to_numpy(zero_copy_only=False), bool)
            p = mixture.responsibilities(mixture.standardised(_block(batch))) @ mixture.kinds
            kind = pa.array([mixture.names[b] if w else None for b, w in zip(p.argmax(axis=1), at)], type=pa.string())
            chance = pa.array(np.where(at, np.round(p.max(axis=1, initial=0.0), 6), 0.0))
            yield pa.RecordBatch.from_arrays([*batch.columns, kind, chance], names=[*batch.schema.names, "kind", "probability"])

    return run


def text_kinds(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, kind (``prose``, ``list``, ``table``, ``junk``; null for blank texts) and its probability, of every row."""
    stats = written(text_statistics(docs, key, text), "stats")
    mixture = fit_mixture(stats, key)
    return stats.mapInArrow(_named(mixture), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stats.schema.fields) + ", kind string, probability double")
