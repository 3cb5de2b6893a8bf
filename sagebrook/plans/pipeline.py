"""Pipelines of steps over lazy DataFrames.

A step is ``function(input, context, **args)``.  Consecutive parallel steps form a group that runs on the
same input; their results go into the context and the current result stays.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as Late
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame

from sagebrook.telemetry import span


class StepFailed(Exception):
    def __init__(self, step: str, error: Exception):
        super().__init__(f"step {step} failed: {error}")
        self.step, self.error = step, error


class StepTimeout(Exception):
    def __init__(self, step: str):
        super().__init__(f"step {step} timed out")
        self.step = step


@dataclass(frozen=True)
class Step:
    """``inputs``: None for the current result, a step's name, or a list of names; ``on_error``: halt, continue or ("retry", n); ``timeout`` in seconds."""

    name: str
    function: Callable[..., Any]
    args: dict[str, Any] = field(default_factory=dict)
    inputs: str | list[str] | None = None
    parallel: bool = False
    on_error: str | tuple[str, int] = "halt"
    cache: bool = False
    timeout: float | None = None


@dataclass(frozen=True)
class Context:
    """What the steps of a run have made so far."""

    input: Any = None
    query: Any = None
    query_embedding: Any = None
    retrieval_results: Any = None
    reranked_results: Any = None
    context_text: Any = None
    response: Any = None
    metadata: dict[str, Any] = field(default_factory=dict)
    step_results: dict[str, Any] = field(default_factory=dict)
    errors: tuple[tuple[str, str], ...] = ()

    def put_metadata(self, key: str, value: Any) -> Context:
        return replace(self, metadata=self.metadata | {key: value})

    def put_step_result(self, step: str, value: Any) -> Context:
        return replace(self, step_results=self.step_results | {step: value})

    def get_step_result(self, step: str) -> Any:
        return self.step_results.get(step)

    def add_error(self, step: str, error: str) -> Context:
        return replace(self, errors=((step, error), *self.errors))


@dataclass
class Pipeline:
    name: str
    steps: list[Step] = field(default_factory=list)
    description: str = ""
    config: dict[str, Any] = field(default_factory=dict)
    metadata: dict[str, Any] = field(default_factory=dict)
    _cache: dict[tuple, Any] = field(default_factory=dict, repr=False)

    def add_step(self, step: Step | None = None, **fields) -> Pipeline:
        self.steps.append(step or Step(**fields))
        return self

    def execute(self, value: Any, context: Context | None = None, timeout: float | None = None) -> tuple[Any, Context]:
        """(result, context); a failing step that halts raises :class:`StepFailed` or :class:`StepTimeout`."""
        ends = None if timeout is None else time.monotonic() + timeout
        context = replace(context or Context(), input=value)
        for parallel, group in itertools.groupby(self.steps, lambda s: s.parallel):
            if parallel:
                context = self._together(list(group), value, context, ends)
            else:
                for step in group:
                    done, result, context = self._one(step, value, context, ends)
                    value = result if done else value
        return value, context

    def _together(self, steps: list[Step], value: Any, context: Context, ends: float | None) -> Context:
        with ThreadPoolExecutor(len(steps)) as pool:
            runs = [pool.submit(self._one, step, value, context, ends) for step in steps]
            outcomes = [run.result() for run in runs]
        before = len(context.errors)
        for step, (done, result, after) in zip(steps, outcomes):
            context = context.put_step_result(step.name, result) if done else context
            context = replace(context, metadata=context.metadata | after.metadata, errors=(*after.errors[: len(after.errors) - before], *context.errors))
        return context

    def _one(self, step: Step, value: Any, context: Context, ends: float | None) -> tuple[bool, Any, Context]:
        if step.inputs is None:
            source = value
        elif isinstance(step.inputs, str):
            source = context.get_step_result(step.inputs)
        else:
            source = {n: context.get_step_result(n) for n in step.inputs}
        key = (step.name, _mark(source), repr(sorted(step.args.items(), key=lambda kv: kv[0])))
        if step.cache and key in self._cache:
            return True, self._cache[key], context.put_step_result(step.name, self._cache[key])
        tries = 1 + (step.on_error[1] if isinstance(step.on_error, tuple) else 0)
        for attempt in range(tries):
            try:
                with span("pipeline.step", pipeline=self.name, step=step.name, attempt=attempt):
                    result = _limited(step, source, context, ends)
                break
            except Exception as error:  # noqa: BLE001
                if attempt + 1 < tries:
                    continue
                if step.on_error == "continue":
                    return False, None, context.add_error(step.name, str(error))
                raise error if isinstance(error, StepTimeout) else StepFailed(step.name, error) from error
        if step.cache:
            if isinstance(result, DataFrame):
                result = result.persist()
            self._cache[key] = result
        return True, result, context.put_step_result(step.name, result)

    def forget(self) -> None:
        """Drop cached results."""
        for value in self._cache.values():
            if isinstance(value, DataFrame):
                value.unpersist()
        self._cache.clear()


def _mark(value: Any) -> Any:
    """Identity of an input: of a DataFrame its plan's, so that a new input is never answered from the cache."""
    if isinstance(value, DataFrame):
        return ("plan", value.semanticHash())
    if isinstance(value, dict):
        return tuple(sorted((k, _mark(v)) for k, v in value.items()))
    return repr(value)


def _limited(step: Step, source: Any, context: Context, ends: float | None) -> Any:
    limits = [x for x in (step.timeout, None if ends is None else ends - time.monotonic()) if x is not None]
    if not limits:
        return step.function(source, context, **step.args)
    pool = ThreadPoolExecutor(1)
    run = pool.submit(step.function, source, context, **step.args)
    try:
        return run.result(timeout=max(0.0, min(limits)))
    except Late:
        if isinstance(source, DataFrame):
            source.sparkSession.interruptTag(step.name.replace(",", "_"))
        raise StepTimeout(step.name) from None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
