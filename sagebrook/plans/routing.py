"""Choosing a provider for a request.

Routers are small driver-side objects with an injected clock; the same rules over a log of calls are
DataFrame operators (:func:`failure_streaks`, :func:`infer_task`).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sagebrook.models import BEST_FOR
from sagebrook.storage import written

# Words that tell the task of a prompt; those of analysis come first.
ANALYSIS_WORDS = "analyze explain review compare understand describe examine evaluate assess".split()
CODE_WORDS = "write implement create function code develop build make generate class method api endpoint".split()


class NoProvider(Exception):
    """No provider is left for a request."""


@dataclass(frozen=True)
class Request:
    kind: str = "text"
    prompt: str | None = None
    task: str | None = None


class Strategy(Protocol):
    providers: list[str]

    def select(self, request: Request) -> str: ...

    def report(self, provider: str, ok: bool) -> None: ...

    def after(self, failed: str, request: Request) -> str: ...

    def available(self) -> list[str]: ...


def _checked(providers: list[str]) -> None:
    if not providers:
        raise ValueError("no providers")


@dataclass
class Fallback:
    """The first provider in order that hasn't failed too often; failures are forgotten after success or with time."""

    providers: list[str]
    order: list[str] | None = None
    max_failures: int = 3
    decay: float | None = 60.0
    clock: Callable[[], float] = time.monotonic
    failures: dict[str, int] = field(default_factory=dict)
    last: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        _checked(self.providers)
        self.order = list(self.order or self.providers)

    def _forget(self) -> None:
        if self.decay is not None:
            now = self.clock()
            for p in [p for p, t in self.last.items() if now - t >= self.decay]:
                self.failures[p] = 0

    def available(self) -> list[str]:
        self._forget()
        return [p for p in self.order if self.failures.get(p, 0) < self.max_failures]

    def select(self, request: Request) -> str:
        left = self.available()
        if not left:
            raise NoProvider("all_providers_failed")
        return left[0]

    def report(self, provider: str, ok: bool) -> None:
        if ok:
            self.failures[provider] = 0
            self.last.pop(provider, None)
        else:
            self.failures[provider] = self.failures.get(provider, 0) + 1
            self.last[provider] = self.clock()

    def after(self, failed: str, request: Request) -> str:
        self._forget()
        start = self.order.index(failed) + 1 if failed in self.order else 1
        for p in self.order[start:]:
            if self.failures.get(p, 0) < self.max_failures:
                return p
        raise NoProvider("no_more_providers")


@dataclass
class RoundRobin:
    """Providers in turn, or by weights; after several failures in a row a provider rests for a while."""

    providers: list[str]
    weights: dict[str, int] | None = None
    max_failures: int = 3
    rest: float = 30.0
    clock: Callable[[], float] = time.monotonic
    index: int = 0
    left: dict[str, int] = field(default_factory=dict)
    failures: dict[str, int] = field(default_factory=dict)
    resting: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        _checked(self.providers)
        if self.weights is not None:
            if any(self.weights.get(p, 1) < 1 for p in self.providers):
                raise ValueError("weights must be 1 or more")
            self.left = {p: self.weights.get(p, 1) for p in self.providers}

    def available(self) -> list[str]:
        now = self.clock()
        for p in [p for p, since in self.resting.items() if now - since >= self.rest]:
            del self.resting[p]
            self.failures.pop(p, None)
        return [p for p in self.providers if p not in self.resting]

    def _turn(self, start: int, count: int, free: list[str]) -> str | None:
        for k in range(count):
            n = (start + k) % len(self.providers)
            if self.providers[n] in free:
                self.index = (n + 1) % len(self.providers)
                return self.providers[n]
        return None

    def select(self, request: Request) -> str:
        free = self.available()
        if not free:
            raise NoProvider("all_providers_unavailable")
        if self.weights is None:
            return self._turn(self.index, len(self.providers), free)
        if not any(self.left.get(p, 0) > 0 for p in free):
            self.left = {p: self.weights.get(p, 1) for p in free}
        chosen = next(p for p in free if self.left.get(p, 0) > 0)
        self.left[chosen] -= 1
        return chosen

    def report(self, provider: str, ok: bool) -> None:
        self.failures[provider] = 0 if ok else self.failures.get(provider, 0) + 1
        if self.failures[provider] >= self.max_failures:
            self.resting[provider] = self.clock()

    def after(self, failed: str, request: Request) -> str:
        free = self.available()
        start = self.providers.index(failed) if failed in self.providers else 0
        chosen = self._turn(start + 1, len(self.providers) - 1, free)
        if chosen is None:
            raise NoProvider("no_more_providers")
        return chosen


def task_of(prompt: str) -> str:
    low = prompt.lower()
    return "analysis" if any(w in low for w in ANALYSIS_WORDS) else "code_generation" if any(w in low for w in CODE_WORDS) else "general"


@dataclass
class Specialist:
    """The provider that is best for the task; else the fallback, else the first available one."""

    providers: list[str]
    mappings: dict[str, str] | None = None
    fallback: str | None = None
    max_failures: int = 3
    failures: dict[str, int] = field(default_factory=dict)
    out: set[str] = field(default_factory=set)

    def __post_init__(self):
        _checked(self.providers)
        self.mappings = BEST_FOR | (self.mappings or {})
        self.fallback = self.fallback or self.providers[0]

    def available(self) -> list[str]:
        return [p for p in self.providers if p not in self.out]

    def task(self, request: Request) -> str:
        if request.task is not None:
            return request.task
        if request.kind == "embeddings":
            return "embeddings"
        return task_of(request.prompt) if isinstance(request.prompt, str) else "general"

    def select(self, request: Request) -> str:
        free = self.available()
        if not free:
            raise NoProvider("all_providers_unavailable")
        return next((p for p in (self.mappings.get(self.task(request)), self.fallback) if p in free), free[0])

    def report(self, provider: str, ok: bool) -> None:
        self.failures[provider] = 0 if ok else self.failures.get(provider, 0) + 1
        if self.failures[provider] >= self.max_failures:
            self.out.add(provider)

    def after(self, failed: str, request: Request) -> str:
        free = [p for p in self.available() if p != failed]
        if not free:
            raise NoProvider("no_more_providers")
        return self.fallback if self.fallback in free else free[0]


class Router:
    """Routes requests to providers by a strategy; without one, three or more providers are specialists, fewer a fallback order."""

    def __init__(self, providers: dict[str, Any], strategy: str | Strategy | None = None, **options):
        names = list(providers)
        _checked(names)
        self.providers = providers
        if strategy is None:
            strategy = "specialist" if len(names) >= 3 else "fallback"
        kinds = {"fallback": Fallback, "round_robin": RoundRobin, "specialist": Specialist}
        if isinstance(strategy, str) and strategy not in kinds:
            raise ValueError(f"unknown strategy {strategy}")
        self.strategy = kinds[strategy](names, **options) if isinstance(strategy, str) else strategy

    def route(self, request: Request) -> str:
        return self.strategy.select(request)

    def report_result(self, provider: str, ok: bool) -> None:
        self.strategy.report(provider, ok)

    def next_provider(self, failed: str, request: Request) -> str:
        return self.strategy.after(failed, request)

    def available_providers(self) -> list[str]:
        return self.strategy.available()

    def get_provider(self, name: str) -> Any:
        return self.providers[name]

    def execute(self, request: Request, call: Callable[[Any, Request], Any] | None = None) -> tuple[Any, str]:
        """The result and the provider that gave it; failing providers are reported and the next is tried, each once."""
        call = call or (lambda p, r: p.embed([r.prompt])[0] if r.kind == "embeddings" else p.generate([r.prompt])[0])
        name, tried = self.route(request), set()
        while name not in tried:
            tried.add(name)
            try:
                result = call(self.providers[name], request)
            except Exception:  # noqa: BLE001
                self.report_result(name, False)
                try:
                    name = self.next_provider(name, request)
                except NoProvider:
                    break
            else:
                self.report_result(name, True)
                return result, name
        raise NoProvider("all_providers_failed")


def infer_task(prompt: Column) -> Column:
    """Task of a prompt column by the same words."""
    low = F.lower(prompt)
    return F.when(low.rlike("|".join(ANALYSIS_WORDS)), "analysis").when(low.rlike("|".join(CODE_WORDS)), "code_generation").otherwise("general")


def preferred_provider(task: Column, fallback: str = "gemini") -> Column:
    table = F.create_map(*(F.lit(x) for pair in sorted(BEST_FOR.items()) for x in pair))
    return F.coalesce(F.try_element_at(table, task), F.lit(fallback))


def failure_streaks(calls: DataFrame, by: str = "provider", failed: str = "failed", order: list[str] | None = None, max_failures: int = 3) -> DataFrame:
    """Calls with ``streak``, failures in a row up to the call, and ``tripped``, whether that reaches the limit.

    The log is range-partitioned by provider and time, so that one provider's calls are many tasks.  Each part counts
    its own runs between successes; what runs over from earlier parts is summed over one row a part and
    added to the failures before a part's first success.  A null outcome is no failure.
    """
    order = order or ["ts", "event_id"]
    placed = written(calls.repartitionByRange(by, *order).withColumn("__part", F.spark_partition_id()), "log")
    bad = F.when(F.col(failed), 1).otherwise(0)
    so_far = Window.partitionBy(by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = placed.withColumn("__run", F.sum(1 - bad).over(so_far))
    in_run = Window.partitionBy(by, "__part", "__run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = written(runs.withColumn("streak", F.sum(bad).over(in_run)), "streaks")
    ends = local.groupBy(by, "__part").agg(F.max("__run").alias("good"), F.max_by("streak", F.struct(*order)).alias("tail"))
    parts = Window.partitionBy(by).orderBy("__part")
    chained = ends.withColumn("chain", F.sum(F.when(F.col("good") > 0, 1).otherwise(0)).over(parts.rowsBetween(Window.unboundedPreceding, 0)))
    out = chained.withColumn("out", F.sum("tail").over(Window.partitionBy(by, "chain").orderBy("__part").rowsBetween(Window.unboundedPreceding, 0)))
    carried = out.select(by, "__part", F.coalesce(F.lag("out").over(parts), F.lit(0)).alias("carry"))
    joined = local.join(carried, (local[by].eqNullSafe(carried[by])) & (local["__part"] == carried["__part"]), "left").drop(carried[by], carried["__part"])
    streak = F.col("streak") + F.when(F.col("__run") == 0, F.coalesce("carry", F.lit(0))).otherwise(0)
    return joined.withColumn("streak", streak).withColumn("tripped", F.col("streak") >= max_failures).drop("__part", "__run", "carry")
