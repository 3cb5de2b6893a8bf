"""A circuit breaker over a stream of calls, by keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


class _Breaker(StatefulProcessor):
    """Failures in a row by provider; a tripped provider recovers after a rest."""

    def __init__(self, limit: int, rest_ms: int):
        self.limit, self.rest_ms = limit, rest_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("failures", StructType([StructField("failures", IntegerType()), StructField("since", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        failures, since = self.state.get() if self.state.exists() else (0, -1)
        for part in rows:  # one Arrow batch at a time, in order of arrival; within a batch by time
            out = []
            for row in part.sort_values(["ts", "event_id"]).itertuples():
                now = int(pd.Timestamp(row.ts).value // 1_000_000)
                if since >= 0 and now - since >= self.rest_ms:
                    failures, since = 0, -1
                failures = failures + 1 if row.failed else 0
                if failures >= self.limit and since < 0:
                    since = now
                if not row.failed:
                    since = -1
                out.append((key[0], row.event_id, failures, since >= 0))
            yield pd.DataFrame(out, columns=["provider", "event_id", "streak", "open"])
        self.state.update((failures, since))

    def close(self) -> None:
        pass


def circuit_breaker(calls: DataFrame, limit: int = 3, rest_ms: int = 30_000) -> DataFrame:
    """(provider, event_id, streak, open) of a stream of calls (provider, event_id, ts, failed)."""
    return calls.groupBy("provider").transformWithStateInPandas(
        statefulProcessor=_Breaker(limit, rest_ms), outputStructType="provider long, event_id long, streak int, open boolean", outputMode="Append", timeMode="None"
    )


def windowed_failures(calls: DataFrame, size: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """(window, provider, calls, failures) of a stream, with a watermark for late calls."""
    from pyspark.sql import functions as F

    rows = calls.withWatermark("ts", late).groupBy(F.window("ts", size), "provider")
    return rows.agg(F.count("*").alias("calls"), F.sum(F.col("failed").cast("int")).alias("failures"))
