"""Health: breakers, budgets, readiness, admission and metrics over outcome rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weirflow.operators.folds import ordered_fold, running_total, sliding_share

# Histogram bounds of request durations in seconds, state names and ranks, legal moves.
BUCKETS = (0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)
ENDPOINT_RANK = {"HEALTHY": 0, "CB_HALF_OPEN": 1, "WARMING_UP": 2, "UNHEALTHY": 3, "CB_OPEN": 4}
ROUTE_MOVES = {
    "WARMING_UP": ("READY", "NOT_READY", "DRAINING"),
    "READY": ("NOT_READY", "DEGRADED", "DRAINING"),
    "NOT_READY": ("READY", "DEGRADED", "DRAINING"),
    "DEGRADED": ("READY", "NOT_READY", "DRAINING"),
    "DRAINING": (),
}
#: Outcomes that a breaker without configuration remembers.
REMEMBERED = 32
#: Seconds of a key's rows that one task sorts.
RANGE_S = 21_600


def failure_ratio(outcomes: DataFrame, endpoint: str, at: str, failed: Column, window_s: float) -> DataFrame:
    """``failure_ratio`` of each endpoint over the window that ends with each outcome."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    span = int(window_s * 1_000_000)
    return sliding_share(outcomes, endpoint, micros, failed, span, RANGE_S * 1_000_000, "failure_ratio")


@dataclass
class Breaker:
    """Circuit breaker of an endpoint; times in ms.

    A failure opens it if the window's failure share reaches ``rate``; after a
    backoff one outcome decides. The first backoff is ``base``; each further one
    may be twice as long, up to ``most``, until a half-open success. Where jitter
    would choose a wait between ``base`` and the present backoff, this takes the
    greatest. Without a ``rate`` each outcome decides by itself.
    """

    rate: float | None = None
    window: int = 0
    base: int = 0
    most: int = 0
    state: str = "HEALTHY"
    until: int | None = None
    backoff: int | None = None
    events: list[tuple[int, bool]] = field(default_factory=list)

    def tick(self, now: int) -> None:
        if self.state == "CB_OPEN" and self.until is not None and now >= self.until:
            self.until = None
            self._move("CB_HALF_OPEN")

    def observe(self, now: int, ok: bool) -> str:
        self.tick(now)
        self.events.append((now, ok))
        if self.rate is None:
            del self.events[:-REMEMBERED]
            self._move("HEALTHY" if ok else "UNHEALTHY")
            return self.state
        self.events = [e for e in self.events if now - e[0] <= self.window]
        if self.state == "CB_HALF_OPEN" and ok:
            self.backoff = self.base
            self._move("HEALTHY")
        elif self.state == "CB_HALF_OPEN":
            self._open(now)
        elif self.state != "CB_OPEN":
            failures = sum(not good for _, good in self.events)
            if ok:
                self._move("HEALTHY")
            elif failures / len(self.events) >= self.rate:
                self._open(now)
            else:
                self._move("UNHEALTHY")
        return self.state

    def _move(self, state: str) -> None:
        if state == "HEALTHY" and self.state != state:
            self.events = []
        self.state = state

    def _open(self, now: int) -> None:
        wait = self.backoff if self.backoff is not None else max(self.base, 1)
        self.backoff = min(2 * wait, self.most)
        self.until = now + max(wait, self.base)
        self._move("CB_OPEN")


def breaker_states(
    outcomes: DataFrame, rate: float | None = None, window: int = 0, base: int = 0, most: int = 0
) -> DataFrame:
    """State after each outcome of ``outcomes(endpoint, at_ms, seq, ok)``; folded in order per endpoint."""

    def step(breaker: Breaker, row: tuple) -> tuple:
        return (*row, breaker.observe(int(row[1]), bool(row[3])))

    rows = outcomes.select("endpoint", "at_ms", "seq", "ok")
    schema = "endpoint string, at_ms long, seq long, ok boolean, state string"
    return ordered_fold(rows, "endpoint", ["at_ms", "seq"], lambda: Breaker(rate, window, base, most), step, schema)


@dataclass
class BudgetTracker:
    """Attempts of a route in a window that restarts once older than ``max_elapsed`` ms; null: no bound."""

    max_attempts: int | None
    max_elapsed: int | None
    start: int | None = None
    used: int = 0

    def attempt(self, now: int) -> tuple[int, bool]:
        if self.start is None or (self.max_elapsed is not None and now - self.start > self.max_elapsed):
            self.start, self.used = now, 0
        self.used += 1
        return self.used, self.max_attempts is not None and self.used > self.max_attempts


def budget_windows(attempts: DataFrame, max_attempts: int | None, max_elapsed: int | None) -> DataFrame:
    """``used`` and ``exhausted`` after each of ``attempts(route, at_ms, seq)``; folded in order per route."""

    def step(tracker: BudgetTracker, row: tuple) -> tuple:
        return (row[0], row[2], *tracker.attempt(int(row[1])))

    rows = attempts.select("route", "at_ms", "seq")
    schema = "route string, seq long, used long, exhausted boolean"
    return ordered_fold(rows, "route", ["at_ms", "seq"], lambda: BudgetTracker(max_attempts, max_elapsed), step, schema)


def _rank(state: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, rank in ENDPOINT_RANK.items():
        out = F.when(state == name, rank).otherwise(out)
    return out


def worst_endpoint(states: DataFrame, key: str) -> DataFrame:
    """The worst state that any source reports of an endpoint."""
    return states.groupBy(key).agg(F.max_by("state", _rank(F.col("state"))).alias("state"))


def route_states(edges: DataFrame, partial: Column | None = None, half_open_degrades: bool = True) -> DataFrame:
    """State of each route from ``edges(route, state)`` of its endpoints (null: no endpoint)."""
    has = lambda *names: F.bool_or(F.coalesce(F.col("state").isin(*names), F.lit(False)))
    facts = edges.groupBy("route").agg(
        has("WARMING_UP").alias("warming"), has("UNHEALTHY", "CB_OPEN").alias("broken"), has("CB_HALF_OPEN").alias("half"),
        F.bool_or(partial if partial is not None else F.lit(False)).alias("partial"),
    )
    state = (
        F.when(F.col("warming"), "WARMING_UP")
        .when(F.col("broken") & F.col("partial"), "DEGRADED")
        .when(F.col("broken"), "NOT_READY")
        .when(F.col("half"), F.lit("DEGRADED" if half_open_degrades else "NOT_READY"))
        .otherwise("READY")
    )
    return facts.select("route", state.alias("state"))


def app_state(routes: DataFrame, threshold: int | None = None) -> DataFrame:
    """One row: the application's state from ``routes(route, state, priority, ordinal)``.

    Without routes it is ready; one draining route makes it draining. It is ready
    if all routes are ready or degraded, or with a numeric ``threshold`` the first
    so many by priority and ordinal; a degraded route anywhere then makes it
    degraded. Else it is warming up as long as no route is up and one warms up.
    ``n`` and ``up`` count all routes.
    """
    # Rows of the first routes are marked and added to the others, so that one aggregate sees both.
    first = routes.orderBy("priority", "ordinal").limit(threshold if threshold is not None else 0)
    marked = routes.select("state", F.lit(False).alias("first")).union(first.select("state", F.lit(True)))
    count = lambda *states, first=False: F.count_if((F.col("first") == first) & F.col("state").isin(*states))
    facts = marked.agg(
        F.count_if(~F.col("first")).alias("n"),
        count("READY", "DEGRADED").alias("up"),
        count("READY", "DEGRADED", first=True).alias("first_up"),
        F.count_if("first").alias("required"),
        count("DRAINING").alias("draining"),
        count("DEGRADED").alias("degraded"),
        count("WARMING_UP").alias("warming"),
    )
    met = F.col("up") == F.col("n") if threshold is None else F.col("first_up") == F.col("required")
    state = (
        F.when(F.col("n") == 0, "READY")
        .when(F.col("draining") > 0, "DRAINING")
        .when(met & (F.col("degraded") > 0), "DEGRADED")
        .when(met, "READY")
        .when((F.col("up") == 0) & (F.col("warming") > 0), "WARMING_UP")
        .otherwise("NOT_READY")
    )
    return facts.select("n", "up", state.alias("state"))


def moves_legal(log: DataFrame, key: str, order: list[str], moves=ROUTE_MOVES) -> DataFrame:
    """Each state change of a key with whether it is allowed; staying is."""
    spark = log.sparkSession
    allowed = spark.createDataFrame([(a, b) for a, bs in moves.items() for b in bs], "previous string, state string")
    before = F.lag("state").over(Window.partitionBy(key).orderBy(*order))
    steps = log.withColumn("previous", before).where("previous is not null and previous != state")
    return steps.join(F.broadcast(allowed.withColumn("legal", F.lit(True))), ["previous", "state"], "left").withColumn(
        "legal", F.coalesce("legal", F.lit(False))
    )


def dependencies(phases: DataFrame) -> DataFrame:
    """Sorted distinct connectors of each route from ``phases(route, connector)``."""
    return phases.groupBy("route").agg(F.array_sort(F.collect_set("connector")).alias("connectors"))


def expand_requires(edges: DataFrame, requires: DataFrame) -> DataFrame:
    """``edges(route, connector)`` and what those connectors require, one step far."""
    more = edges.join(requires.select("connector", F.col("required").alias("__r")), "connector").select("route", F.col("__r").alias("connector"))
    return edges.select("route", "connector").union(more).distinct()


def dependents(states: DataFrame, edges: DataFrame) -> DataFrame:
    """``states(endpoint, state)`` told to each route that depends on the endpoint: ``edges(route, endpoint)``."""
    return states.join(edges, "endpoint")


def merged_budgets(budgets: DataFrame, key: str) -> DataFrame:
    """The strictest of each key's budgets; unset fields are passed over."""
    rank = F.when(F.col("jitter") == "full", 2).when(F.col("jitter") == "equal", 1).when(F.col("jitter") == "none", 0)
    return budgets.groupBy(key).agg(
        F.min("max_attempts").alias("max_attempts"), F.min("max_elapsed").alias("max_elapsed"),
        F.max("base_backoff").alias("base_backoff"), F.min("max_backoff").alias("max_backoff"),
        F.max_by("jitter", rank).alias("jitter"),
    )


def in_flight(intervals: DataFrame, key: str) -> DataFrame:
    """Running number of open intervals of ``intervals(key, start, end)`` (s) at each start; ends come first on ties."""
    starts = intervals.select(key, F.col("start").alias("at"), F.lit(1).alias("step"))
    ends = intervals.select(key, F.col("end").alias("at"), F.lit(-1).alias("step"))
    moves = starts.union(ends).groupBy(key, "at").agg(
        F.sum(F.when(F.col("step") == 1, 1).otherwise(0)).alias("arrivals"), F.sum("step").alias("net")
    )
    total = running_total(moves, key, "at", F.col("net"), RANGE_S, "inflight")
    return total.where("arrivals > 0").select(key, "at", "arrivals", "inflight")


@dataclass
class Gate:
    """Admission to a route: ``limit`` at work, ``queue`` waiting in order of arrival, others turned away.

    Who is turned away holds no place. ``ends`` are the times at which those at
    work or waiting will have left, sorted.
    """

    limit: int
    queue: int
    ends: list[int] = field(default_factory=list)

    def arrive(self, at: int, duration: int) -> tuple[str, int | None, int]:
        """What becomes of an arrival, when it begins, and how many wait after it."""
        self.ends = [e for e in self.ends if e > at]
        held = len(self.ends)
        waiting = max(held - self.limit, 0)
        if held >= self.limit + self.queue:
            return "rejected", None, waiting
        begins = at if held < self.limit else self.ends[held - self.limit]
        self.ends = sorted([*self.ends, begins + duration])
        return ("admitted", begins, waiting) if held < self.limit else ("queued", begins, waiting + 1)


def admission(arrivals: DataFrame, limit: int | None, queue: int = 0) -> DataFrame:
    """``outcome``, ``begins`` and ``waiting`` of each of ``arrivals(route, at, seq, duration)``, in order per route.

    ``queue`` 0 rejects or sheds beyond the limit; a limit of null or 0 admits all.
    """
    rows = arrivals.select("route", "at", "seq", "duration")
    if not limit:
        return rows.select(
            "route", "seq", F.lit("admitted").alias("outcome"), F.col("at").alias("begins"), F.lit(0).cast("long").alias("waiting")
        )

    def step(gate: Gate, row: tuple) -> tuple:
        return (row[0], row[2], *gate.arrive(int(row[1]), int(row[3])))

    schema = "route string, seq long, outcome string, begins long, waiting long"
    return ordered_fold(rows, "route", ["at", "seq"], lambda: Gate(limit, queue), step, schema)


def limit_counters(admissions: DataFrame) -> DataFrame:
    """Per route: how often its limit was enforced, and the greatest queue depth."""
    return admissions.groupBy("route").agg(
        F.count_if(F.col("outcome") == "rejected").alias("limited"), F.max("waiting").alias("queue_depth")
    )


def request_histogram(requests: DataFrame, route: str, seconds: Column) -> DataFrame:
    """Count, sum and cumulative buckets of durations for each route."""
    buckets = [F.count_if(seconds <= b).alias(f"le_{str(b).replace('.', '_')}") for b in BUCKETS]
    return requests.groupBy(route).agg(F.count("*").alias("count"), F.sum(seconds).alias("sum"), *buckets)


def outcome_counts(rows: DataFrame, labels: list[str]) -> DataFrame:
    """A counter family: the number of rows for each combination of labels."""
    return rows.groupBy(*labels).agg(F.count("*").alias("n"))


def last_values(rows: DataFrame, labels: list[str], value: str, order: str) -> DataFrame:
    """A gauge family: the last value for each combination of labels."""
    return rows.groupBy(*labels).agg(F.max_by(value, order).alias(value))


def state_gauge(states: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """``states`` with ``gauge``, the number that stands for the state."""
    out = F.lit(None).cast("int")
    for name, rank in ranks.items():
        out = F.when(F.col("state") == name, rank).otherwise(out)
    return states.withColumn("gauge", out)
