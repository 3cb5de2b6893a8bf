"""Mixing sources to target weights by Poisson replication.

Every document of a source draws its number of uses from a Poisson distribution, capped at the
source's ``max_repeats``, by inverting the distribution at a uniform number that is the hash of
document id and seed.  The draw is a pure expression: no state, no shuffle, the same on every run
and on any number of executors.  Only the totals of the named sources (as many rows as there are
targets) come to the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from sagebrook.storage import small_enough

#: Largest table of targets that is held on the driver; more targets raise an error.
MOST_TARGETS = 100_000


def source_key(column: Column) -> Column:
    """A source regardless of case, outer white space and ``-``, ``_`` or space inside."""
    return F.regexp_replace(F.lower(F.regexp_replace(column, r"^[\s ]+|[\s ]+$", "")), r"[-_ ]+", "_")


def _cdf(rate: float, cap: int) -> list[float]:
    """P(X <= k) for k below cap."""
    out, total = [], 0.0
    for k in range(cap):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        out.append(min(1.0, total))
    return out


def capped_rate(mean: float, cap: int) -> list[float]:
    """Distribution below ``cap`` of the Poisson whose value, cut at ``cap``, has the given mean.

    A mean of ``cap`` or more gives zeros: every draw is then ``cap``.
    """
    if cap <= 0 or mean <= 0:
        return [1.0]
    if mean >= cap * (1 - 1e-9):
        return [0.0] * cap
    low, high = 0.0, 1.0
    cut = lambda rate: cap - sum(_cdf(rate, cap))
    while cut(high) < mean:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cut(middle) < mean else (low, middle)
    return _cdf(high, cap)


def plan_mix(available: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None = None, floor: float = 0.1) -> dict[str, float]:
    """Mean number of uses of a document, by source.

    ``total`` is the wanted size of the mix.  Without it the mix is the largest in which every source
    that has documents still reaches its weight under its cap, but at least ``floor`` of all
    available tokens: one tiny source must not shrink the mix to nothing.  What a source can't
    supply is shared out among the others by weight, so the total is kept as long as caps allow.
    """
    have = {s: n for s, n in available.items() if n > 0 and targets.get(s, (0, 0))[0] > 0 and targets[s][1] > 0}
    if not have:
        return {}
    share = sum(targets[s][0] for s in have)
    most = {s: n * targets[s][1] for s, n in have.items()}
    if total is None:
        total = max(min(most[s] * share / targets[s][0] for s in have), floor * sum(have.values()))
    total = min(total, sum(most.values()))
    rates: dict[str, float] = {}
    left, open_, rest = total, dict(have), share
    while open_:
        full = [s for s in open_ if left * targets[s][0] / rest >= most[s]]
        if not full:
            return rates | {s: left * targets[s][0] / rest / n for s, n in open_.items()}
        for s in full:
            rates[s] = float(targets[s][1])
            del open_[s]
        left = total - sum(most[s] for s in rates)
        rest = sum(targets[s][0] for s in open_) or 1.0
    return rates


def draw_mix(sized: DataFrame, targets: DataFrame, seed: int = 17, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix and its report.

    ``sized``: (doc_id, source, n_tokens), ``targets``: (source, weight, max_repeats).  Returns
    ``mix(doc_id, source, copy, n_tokens, shuffle_key)``, one row a use, ordered by a hash of document
    and copy (a global shuffle by range exchange), and ``shares(source, weight, max_repeats, available_tokens,
    n_documents, mean_repeats, drawn_uses, drawn_tokens, share)``, one row a target.

    Null sources and sources without target are left out; targets without documents have share 0;
    null or negative weights and repeats count as 0; targets whose keys agree are added up, with the
    larger cap; documents of 0 tokens are drawn like the others; repeated rows are drawn alike.
    """
    spark = sized.sparkSession
    goal = {r.key: (float(r.w or 0), int(r.m or 0)) for r in targets.select(source_key(F.col("source")).alias("key"), F.greatest("weight", F.lit(0.0)).alias("w"), F.greatest("max_repeats", F.lit(0)).alias("m")).where("key IS NOT NULL").groupBy("key").agg(F.sum("w").alias("w"), F.max("m").alias("m")).limit(MOST_TARGETS + 1).collect()}
    if len(goal) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    keyed = sized.select("doc_id", source_key(F.col("source")).alias("source"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    keys = spark.createDataFrame([(s,) for s in sorted(goal)], "source string")
    keyed = keyed.join(F.broadcast(keys), "source", "left_semi")  # at most MOST_TARGETS names
    have = {r.source: (r.n, r.d) for r in keyed.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("d")).collect()}
    rates = plan_mix({s: n for s, (n, _) in have.items()}, goal, total)
    tables = {s: capped_rate(r, goal[s][1]) for s, r in rates.items()}
    drawing = spark.createDataFrame(sorted(tables.items()), "source string, below array<double>")
    if small_enough(sum(map(len, tables.values())) + len(tables)):
        drawing = F.broadcast(drawing)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    uses = F.size(F.filter("below", lambda c: F.col("__u") >= c))
    drawn = keyed.join(drawing, "source").withColumn("__u", uniform).withColumn("uses", uses).where("uses > 0").select("doc_id", "source", "n_tokens", "uses")
    mix = drawn.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("copy"), "n_tokens").withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy")).orderBy("shuffle_key", "doc_id", "copy")
    rows = [(s, w, m, int(have.get(s, (0, 0))[0] or 0), int(have.get(s, (0, 0))[1]), float(rates.get(s, 0.0))) for s, (w, m) in sorted(goal.items())]
    plan = spark.createDataFrame(rows, "source string, weight double, max_repeats int, available_tokens long, n_documents long, mean_repeats double")
    got = drawn.groupBy("source").agg(F.sum("uses").cast("long").alias("drawn_uses"), F.sum(F.col("uses") * F.col("n_tokens")).cast("long").alias("drawn_tokens"))
    whole = F.sum("drawn_tokens").over(Window.partitionBy(F.lit(0)))  # as many rows as there are targets
    shares = plan.join(got, "source", "left").withColumn("all_tokens", whole).select(
        "source", "weight", "max_repeats", "available_tokens", "n_documents", "mean_repeats",
        F.coalesce("drawn_uses", F.lit(0)).cast("long").alias("drawn_uses"), F.coalesce("drawn_tokens", F.lit(0)).cast("long").alias("drawn_tokens"),
        F.round(F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("share"),
    )
    return mix, shares
