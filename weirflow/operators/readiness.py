"""Readiness on the driver: warm-up, cached snapshots, request places, management reports."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Numbers that stand for states in gauges.
ROUTE_GAUGE = {"WARMING_UP": 0, "READY": 1, "NOT_READY": 2, "DEGRADED": 3, "DRAINING": 4}


@dataclass(frozen=True)
class WarmUp:
    """How a connector is warmed up: attempts and waits in ms, which double at most eight times."""

    attempts: int = 3
    base: int = 250
    most: int = 2_000
    timeout: int = 30_000

    def wait(self, attempt: int) -> int:
        """The wait after a failed attempt, counted from 1."""
        return min(self.base * 2 ** min(attempt - 1, 8), max(self.most, self.base))


def warm_up(
    spark: SparkSession,
    probes: dict[str, Callable[[], Any]],
    plan: WarmUp = WarmUp(),
    sleep: Callable[[float], None] = time.sleep,
    clock: Callable[[], float] = time.monotonic,
) -> DataFrame:
    """``(connector, state, attempts, duration_ms, error)`` of one probe for each connector, retried.

    A probe succeeds if it returns; connectors are configuration, so this is a
    loop on the driver.
    """
    out = []
    for name, probe in sorted(probes.items()):
        began, error, attempt = clock(), None, 0
        while attempt < plan.attempts:
            attempt += 1
            try:
                probe()
                error = None
                break
            except Exception as raised:  # noqa: BLE001 - whatever a probe raises is its failure
                error = str(raised)
            spent = (clock() - began) * 1000
            if attempt < plan.attempts:
                if spent + plan.wait(attempt) > plan.timeout:
                    error = f"{error}; no time is left for another attempt"
                    break
                sleep(plan.wait(attempt) / 1000)
        state = "HEALTHY" if error is None else "UNHEALTHY"
        out.append((name, state, attempt, int((clock() - began) * 1000), error))
    return spark.createDataFrame(out, "connector string, state string, attempts int, duration_ms long, error string")


@dataclass
class Snapshots:
    """A value that is made anew once it is older than ``keep_ms``, 50 at least."""

    make: Callable[[], Any]
    keep_ms: int = 250
    clock: Callable[[], float] = time.monotonic
    _made: float | None = None
    _value: Any = None

    def get(self) -> Any:
        now = self.clock()
        if self._made is None or (now - self._made) * 1000 >= max(self.keep_ms, 50):
            self._value, self._made = self.make(), now
        return self._value

    def drop(self) -> None:
        """Forget the value, as after a change of state."""
        self._made = None


@dataclass
class RequestPlaces:
    """Places for requests at work; who finds none is turned away at once with status 429.

    The answer of a route is kept for as long as readiness snapshots are.
    """

    limit: int = 512
    keep_ms: int = 250
    clock: Callable[[], float] = time.monotonic
    _taken: int = 0
    _lock: Any = field(default_factory=threading.Lock)
    _answers: dict[str, Snapshots] = field(default_factory=dict)

    @contextmanager
    def place(self) -> Iterator[bool]:
        """Whether there was a place; it is free again afterwards."""
        with self._lock:
            got = self._taken < self.limit
            self._taken += got
        try:
            yield got
        finally:
            with self._lock:
                self._taken -= got

    def refusal(self, route: str, retry_after: int = 1) -> dict[str, Any]:
        """The answer to a request that found no place."""
        if route not in self._answers:
            body = {"error": "LIMITS_ENFORCED", "route": route, "retry_after_seconds": retry_after}
            self._answers[route] = Snapshots(lambda: {"status": 429, "body": json.dumps(body)}, self.keep_ms, self.clock)
        return self._answers[route].get()


def exposition(families: dict[str, DataFrame], value: str = "value") -> str:
    """Metric families as text: a line for each row, its other columns as labels, in the order of the labels.

    Families are small tables, a row for each combination of labels.
    """
    lines = []
    for name, table in families.items():
        labels = sorted(c for c in table.columns if c != value)
        lines.append(f"# TYPE {name} gauge")
        for row in sorted(table.collect(), key=lambda r: tuple(str(r[c]) for c in labels)):
            escaped = (str(row[c]).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") for c in labels)
            text = ",".join(f'{c}="{v}"' for c, v in zip(labels, escaped, strict=True))
            lines.append(f"{name}{{{text}}} {row[value]}" if labels else f"{name} {row[value]}")
    return "\n".join(lines) + "\n"


def management(app: DataFrame, routes: DataFrame, endpoints: DataFrame) -> dict[str, tuple[int, dict[str, Any]]]:
    """Status and body of the endpoints ``live``, ``ready`` and ``status``.

    ``app(state)`` has one row; ``routes(route, state)`` and ``endpoints(endpoint,
    state)`` one for each configured name.
    """
    state = app.first()["state"]
    listed = {r.route: r.state for r in routes.select("route", "state").collect()}
    known = {r.endpoint: r.state for r in endpoints.select("endpoint", "state").collect()}
    up = state in ("READY", "DEGRADED")
    report = {"state": state, "routes": dict(sorted(listed.items())), "endpoints": dict(sorted(known.items()))}
    return {
        "live": (200, {"status": "live"}),
        "ready": (200 if up else 503, {"state": state}),
        "status": (200, report),
    }
