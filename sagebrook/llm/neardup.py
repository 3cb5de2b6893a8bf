"""Near-duplicate texts by HyperMinHash.

Method: the runs of consecutive words of a text are hashed; in each of several rounds a run falls
into one of a fixed number of buckets, and a bucket keeps the smallest hash, compressed to the
count of its leading zeros and the next mantissa bits.  Bands of registers are the blocking keys.
Texts that share a band are compared by their registers, with the agreements that compression
and empty buckets cause by chance taken out, and what may reach the threshold is verified on the
sets of runs themselves.

Equal texts are one class from the start: only one of them takes part, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sagebrook.operators.components import connected_components
from sagebrook.storage import dropped, semi_join, small_enough, spread, written

#: Rounds of hashing, buckets a round, registers a band, bits of the mantissa.
ROUNDS, BUCKETS, ROWS, MANTISSA = 12, 16, 4, 10
REGISTERS = ROUNDS * BUCKETS
#: Registers of the first rounds, by which candidates are estimated.
MARKED = 6 * BUCKETS
EMPTY = 0xFFFF
#: Classes of one block of a band.
BAND_BLOCK = 1000
#: Words whose hashes a worker remembers; the table is emptied when full.
REMEMBERED = 500_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


@lru_cache(maxsize=1)
def _hashes() -> _Hashes:
    return _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


def runs_of(texts: list[str | None], size: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of ``size`` words of all texts, with the number of their text.

    Returns (run hashes, owner of each, texts that have at least ``least_words`` words, hash of each text's words).
    """
    table = _hashes()
    kept, lengths, flat = [], [], []
    for n, text in enumerate(texts):
        found = words(text) if text else []
        if len(found) >= max(least_words, size):
            kept.append(n)
            lengths.append(len(found))
            flat.extend(map(table.__getitem__, found))
    if not kept:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.array(flat, dtype=np.uint64)
    lengths_, owner = np.array(lengths), np.repeat(np.arange(len(kept)), lengths)
    starts = np.cumsum(lengths_) - lengths_
    with np.errstate(over="ignore"):
        place = np.arange(len(h), dtype=np.uint64) - starts.astype(np.uint64)[owner]
        whole = np.add.reduceat(_mix(h + (place + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), starts)
        run = h[: len(h) - size + 1].copy()
        for k in range(1, size):
            run = _mix(run) + h[k : len(h) - size + 1 + k] * np.uint64(2 * k + 0x2545F4914F6CDD1D)
        run = _mix(run)
    inside = owner[: len(run)] == owner[size - 1 :]
    return run[inside], owner[: len(run)][inside], np.array(kept), _mix(whole ^ lengths_.astype(np.uint64))


def registers(run: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """HyperMinHash sketch (texts x REGISTERS) of runs: leading zeros above the mantissa bits; EMPTY where no run fell."""
    out = np.empty((texts, ROUNDS, BUCKETS), np.uint16)
    bits = BUCKETS.bit_length() - 1
    with np.errstate(over="ignore"):
        for r in range(ROUNDS):
            h = _mix(run + np.uint64((0xD1B54A32D192ED03 * (r + 1)) & (2**64 - 1)))
            low = np.full(texts * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
            np.minimum.at(low, owner * BUCKETS + (h >> np.uint64(64 - bits)).astype(np.int64), h & np.uint64((1 << (64 - bits)) - 1))
            fraction, exponent = np.frexp(low.astype(np.float64) + 1.0)
            zeros = np.clip(64 - bits + 1 - exponent, 0, 62).astype(np.uint16)
            mantissa = ((fraction - 0.5) * (2 << MANTISSA)).astype(np.int64).clip(0, (1 << MANTISSA) - 1).astype(np.uint16)
            code = (zeros << np.uint16(MANTISSA)) | mantissa
            code[low == np.iinfo(np.uint64).max] = EMPTY
            out[:, r] = code.reshape(texts, BUCKETS)
    return out.reshape(texts, REGISTERS)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Blocking keys (texts x bands).  A band takes one register of each of ROWS rounds; empty registers borrow from the next bucket."""
    filled = sketch.reshape(-1, ROUNDS, BUCKETS).copy()
    for step in range(1, BUCKETS):
        gap = filled == EMPTY
        if not gap.any():
            break
        filled[gap] = np.where(np.roll(sketch.reshape(-1, ROUNDS, BUCKETS), -step, axis=2) == EMPTY, EMPTY, np.roll(sketch.reshape(-1, ROUNDS, BUCKETS), -step, axis=2) ^ np.uint16(step << 5))[gap]
    groups = ROUNDS // ROWS
    wide = filled.astype(np.uint64).reshape(-1, groups, ROWS, BUCKETS)
    with np.errstate(over="ignore"):
        key = np.zeros((len(filled), groups, BUCKETS), np.uint64)
        for k in range(ROWS):
            key = (key << np.uint64(16)) | wide[:, :, k]
        key += np.arange(groups * BUCKETS, dtype=np.uint64).reshape(groups, BUCKETS) << np.uint64(58)
        key = _mix(key + np.arange(groups * BUCKETS, dtype=np.uint64).reshape(groups, BUCKETS) * np.uint64(0x9E3779B97F4A7C15))
    return (key.reshape(len(filled), groups * BUCKETS) >> np.uint64(32)).astype(np.uint32)


def marks(sketch: np.ndarray) -> np.ndarray:
    """One byte a register for the estimate: 0 for an empty one, else one of 255 values."""
    x = sketch.astype(np.uint32) * np.uint32(0x9E3779B1)
    return np.where(sketch == EMPTY, 0, 1 + (x >> np.uint32(16)) % np.uint32(255)).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of marked sketches, corrected for chance.

    Of the registers that are filled in either sketch the share that agrees is J + (1 - J) c: two different
    minima agree with probability c.  It has two parts: their codes agree, about 2^-MANTISSA / 3 for the geometric
    exponents, or different codes have one mark, 1 / 255.
    """
    filled = (a != 0) | (b != 0)
    same = ((a == b) & filled).sum(axis=1) / np.maximum(1, filled.sum(axis=1))
    chance = 2.0**-MANTISSA / 3 + 1 / 255
    return np.clip((same - chance) / (1 - chance), 0.0, 1.0)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(size: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 2000):
                part = batch.slice(k, 2000)
                runs, owner, kept, whole = runs_of(part.column(1).to_pylist(), size, least)
                if not len(kept):
                    continue
                sketch = registers(runs, owner, len(kept))
                keys = band_keys(sketch)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel().view(np.int32)))
                codes = pa.array([row.tobytes() for row in marks(sketch[:, :MARKED])], type=pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept)), pa.array(_long(whole)), lists, codes], names=["id", "h", "keys", "codes"])

    return run


def _sets(size: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, owner, kept, whole = runs_of(batch.column(0).to_pylist(), size, least)
            ends = np.zeros(len(kept) + 1, np.int32)
            parts = []
            bounds = np.searchsorted(owner, np.arange(len(kept) + 1))
            for n in range(len(kept)):
                parts.append(np.unique(runs[bounds[n] : bounds[n + 1]]))
            np.cumsum([len(p) for p in parts], out=ends[1:])
            flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(_long(whole)), pa.ListArray.from_arrays(pa.array(ends), pa.array(_long(flat)))], names=["h", "runs"])

    return run


def _likely(threshold: float, slack: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, MARKED) for k in (2, 3))
            filled = ((a != 0) | (b != 0)).sum(axis=1)
            keep = estimate(a, b) >= threshold - slack * np.sqrt(threshold * (1 - threshold) / np.maximum(1, filled))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _met(crowd: DataFrame, shared: DataFrame) -> DataFrame:
    """(a, b) of all classes with a band in common; ``crowd(k, h)``, ``shared(k, n)``.

    A band of many classes is cut into blocks, and each pair of blocks is met on a key of its own, so that no task has a whole band.
    """
    blocks = written(shared.where(F.col("n") > BAND_BLOCK).select("k", F.ceil(F.col("n") / BAND_BLOCK).cast("int").alias("blocks")), "blocks")
    large = blocks.count()
    if not large:
        return crowd.select("k", F.col("h").alias("a")).join(crowd.select("k", F.col("h").alias("b")), "k").where("a < b").select("a", "b")
    cut = crowd.join(F.broadcast(blocks) if small_enough(large) else blocks, "k", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    left = cut.select("k", F.col("h").alias("a"), F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"))
    right = cut.select("k", F.col("h").alias("b"), F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"))
    return left.join(right, ["k", "i", "j"]).where("i < j OR a < b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_texts(docs: DataFrame, key: str = "id", text: str = "content", size: int = 5, threshold: float = 0.8, least_words: int = 0, slack: float = 5.0) -> tuple[DataFrame, DataFrame]:
    """Classes of equal texts and pairs of similar classes.

    Returns ``members(id, h)``, every record that has at least ``least_words`` (and ``size``) words with the class
    of its word sequence, and ``pairs(a, b, similarity)``, the pairs of classes whose sets of runs have a Jaccard
    similarity of at least ``threshold``, a < b.  No pair is capped away: a band is joined with itself, a crowded one in pairs of blocks, the estimate
    drops only pairs ``slack`` standard errors below the threshold, the rest is verified exactly.

    Null and empty texts and texts of fewer words are in no class; rows that share a key and agree in the text
    count once; null keys are ignored; empty tables give empty results; extra columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    sketches = written(spread(source).mapInArrow(_sketch(size, least_words), f"id {kind}, h long, keys array<int>, codes binary"), "sketches")
    members = written(sketches.select("id", "h").distinct(), "members")

    # Bands: one exchange by key; keys of a single class end here.
    bands = sketches.select("h", F.posexplode("keys").alias("band", "part")).select("h", (F.shiftleft(F.col("band").cast("long"), 32) + F.col("part")).alias("k"))
    shared = bands.groupBy("k").agg(F.min("h").alias("low"), F.max("h").alias("high"), F.count("*").alias("n")).where("low < high").select("k", "low", "high", "n")
    shared = written(shared, "shared")
    couples = shared.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    crowd = written(semi_join(bands, shared.where("n > 2"), "k", 8).distinct(), "crowd")
    candidates = written(couples.union(_met(crowd, shared)).distinct(), "candidates")

    # Registers of the classes that are in a candidate pair.
    wanted = written(candidates.select(F.col("a").alias("h")).union(candidates.select(F.col("b").alias("h"))).distinct(), "wanted")
    codes = written(semi_join(sketches.select("h", "codes"), wanted, "h", 8).groupBy("h").agg(F.first("codes").alias("codes")), "codes")
    met = candidates.join(codes.select(F.col("h").alias("a"), F.col("codes").alias("x")), "a").join(codes.select(F.col("h").alias("b"), F.col("codes").alias("y")), "b")
    likely = written(met.select("a", "b", "x", "y").mapInArrow(_likely(threshold, slack), "a long, b long"), "likely")

    # Sets of runs of what is left.
    named = likely.select(F.col("a").alias("h")).union(likely.select(F.col("b").alias("h"))).distinct()
    first = written(members.join(named, "h").groupBy("h").agg(F.min("id").alias("id")), "first")
    sets = semi_join(source, first, "id", 8).select("text").mapInArrow(_sets(size, least_words), "h long, runs array<long>")
    sets = written(sets.groupBy("h").agg(F.first("runs").alias("runs")), "sets")
    both = likely.join(sets.select(F.col("h").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("h").alias("b"), F.col("runs").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    pairs = both.withColumn("c", common).select("a", "b", (F.col("c") / (F.size("x") + F.size("y") - F.col("c"))).alias("similarity"))
    pairs = written(pairs.where(F.col("similarity") >= threshold), "pairs")
    for table in (sketches, shared, crowd, candidates, wanted, codes, likely, first, sets):
        dropped(table)
    return members, pairs


def similar_pairs(docs: DataFrame, key: str = "id", text: str = "content", **options) -> DataFrame:
    """All pairs (id_a, id_b) of records with similar texts, smaller id first, copies of a text included.

    For results that must name every pair; :func:`near_duplicate_groups` keeps classes unexpanded.
    """
    members, pairs = similar_texts(docs, key, text, **options)
    ma, mb = members.select(F.col("h").alias("a"), F.col("id").alias("p")), members.select(F.col("h").alias("b"), F.col("id").alias("q"))
    across = pairs.select("a", "b").join(ma, "a").join(mb, "b").where("p <> q").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    equal = ma.join(mb, F.col("a") == F.col("b")).where("p < q").select(F.col("p").alias("id_a"), F.col("q").alias("id_b"))
    return across.union(equal).distinct()


def near_duplicate_groups(docs: DataFrame, key: str = "id", text: str = "content", **options) -> DataFrame:
    """One row a record: (id, group_id, class_id, class_size, links, keep).

    ``class_id`` is the smallest id of the records with the same words, ``group_id`` the smallest of all records
    linked by a chain of similar pairs, ``links`` the number of other classes similar to the record's own; ``keep``
    marks the one record of each group to be kept.
    """
    members, pairs = similar_texts(docs, key, text, **options)
    classes = members.groupBy("h").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    ends = pairs.select(F.col("a").alias("h")).union(pairs.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("links"))
    heads = written(classes.join(ends, "h", "left").select("h", "class_id", "class_size", F.coalesce("links", F.lit(0)).alias("links")), "heads")
    named = pairs.join(heads.select(F.col("h").alias("a"), F.col("class_id").alias("x")), "a").join(heads.select(F.col("h").alias("b"), F.col("class_id").alias("y")), "b")
    groups = connected_components(named, "x", "y").select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
    small = written(heads.join(groups, "class_id", "left").select("h", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), "class_size", "links"), "groups")
    return members.join(small, "h").select("id", "group_id", "class_id", "class_size", "links", (F.col("id") == F.col("group_id")).alias("keep"))
