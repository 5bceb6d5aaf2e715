"""Streaming forms: the same compiled routes and folds over Structured Streaming."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import asdict
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weirflow.operators.health import Breaker, BudgetTracker

_BREAKER_OUT = "endpoint string, at_ms long, seq long, ok boolean, state string"


def breaker_stream(
    outcomes: DataFrame, rate: float | None = None, window: int = 0, base: int = 0, most: int = 0, timers: bool = False
) -> DataFrame:
    """Breaker states of a stream ``outcomes(endpoint, at_ms, seq, ok)``, kept per endpoint across batches.

    With ``timers``, ``at_ms`` are times of this clock, and an open breaker whose
    backoff is over gives a row of its own, without ``seq`` and ``ok``, even if no
    outcome comes.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        breaker = Breaker(rate, window, base, most)
        if state.exists:
            saved = json.loads(state.get[0])
            breaker = Breaker(**saved | {"events": [tuple(e) for e in saved["events"]]})
        if state.hasTimedOut:
            now, before = int(time.time() * 1000), breaker.state
            breaker.tick(now)
            out = [(key[0], now, None, None, breaker.state)] if breaker.state != before else []
        else:
            rows = pd.concat(list(frames)).sort_values(["at_ms", "seq"], kind="stable")
            out = [
                (key[0], int(t), int(n), bool(ok), breaker.observe(int(t), bool(ok)))
                for t, n, ok in zip(rows.at_ms, rows.seq, rows.ok, strict=True)
            ]
        state.update((json.dumps(asdict(breaker)),))
        if timers and breaker.until is not None:
            state.setTimeoutDuration(max(1, breaker.until - int(time.time() * 1000)))
        frame = pd.DataFrame(out, columns=["endpoint", "at_ms", "seq", "ok", "state"])
        yield frame.astype({"seq": "Int64", "ok": "boolean"})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if timers else GroupStateTimeout.NoTimeout
    return outcomes.groupBy("endpoint").applyInPandasWithState(step, _BREAKER_OUT, "saved string", "append", timeout)


def budget_stream(attempts: DataFrame, max_attempts: int | None, max_elapsed: int | None) -> DataFrame:
    """Retry budget of each route over a stream ``attempts(route, at_ms, seq)``."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = BudgetTracker(max_attempts, max_elapsed, *(state.get if state.exists else ()))
        rows = pd.concat(list(frames)).sort_values(["at_ms", "seq"], kind="stable")
        out = [tracker.attempt(int(t)) for t in rows.at_ms]
        state.update((tracker.start, tracker.used))
        yield rows.assign(used=[o[0] for o in out], exhausted=[o[1] for o in out])[["route", "seq", "used", "exhausted"]]

    return attempts.groupBy("route").applyInPandasWithState(
        step, "route string, seq long, used long, exhausted boolean", "start long, used long", "append",
        GroupStateTimeout.NoTimeout,
    )


def first_seen_stream(rows: DataFrame, keys: list[str], event_time: str, keep: str) -> DataFrame:
    """Rows whose key was not seen within ``keep``; the state does not grow beyond that."""
    return rows.withWatermark(event_time, keep).dropDuplicatesWithinWatermark(keys)


def deliver(rows: DataFrame, sinks: dict[str, Callable[[DataFrame, int], Any]], checkpoint: str, **trigger: Any):
    """Start a stream of actions: each kind goes to its sink, errors to the sink ``error``.

    Sinks get a batch again after a failure; :mod:`weirflow.streaming.sinks` has
    some that tell repeats by (event, idx). ``trigger`` is Spark's.
    """

    def send(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for kind, sink in sinks.items():
                if kind == "error":
                    sink(batch.where("error is not null"), number)
                else:
                    sink(batch.where("error is null").where(batch["kind"] == kind), number)
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
