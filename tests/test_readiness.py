"""Warm-up, cached snapshots, request places, reports and the gate to a route."""

import json

from weirflow import errors
from weirflow.operators import health, readiness


class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_warm_up_retries(spark):
    clock, tries = Clock(), {"slow": 0}

    def slow():
        tries["slow"] += 1
        if tries["slow"] < 3:
            raise OSError("refused")

    def never():
        raise OSError("down")

    plan = readiness.WarmUp(attempts=3, base=100, most=150)
    out = readiness.warm_up(spark, {"slow": slow, "never": never, "good": lambda: None}, plan, clock.sleep, clock)
    got = {r.connector: (r.state, r.attempts, r.duration_ms) for r in out.collect()}
    assert got == {"good": ("HEALTHY", 1, 0), "never": ("UNHEALTHY", 3, 250), "slow": ("HEALTHY", 3, 250)}
    assert [readiness.WarmUp().wait(k) for k in (1, 2, 3, 4, 5)] == [250, 500, 1000, 2000, 2000]
    hurried = readiness.warm_up(spark, {"x": never}, readiness.WarmUp(attempts=9, base=100, most=100, timeout=250), clock.sleep, clock).first()
    assert hurried.attempts == 3 and "no time" in hurried.error


def test_snapshots_are_kept():
    clock, made = Clock(), []
    snapshots = readiness.Snapshots(lambda: made.append(1) or len(made), 10, clock)  # kept 50 ms at least
    first = [snapshots.get(), snapshots.get()]
    clock.now = 0.049
    assert first == [1, 1] and snapshots.get() == 1
    clock.now = 0.05
    assert snapshots.get() == 2
    snapshots.drop()
    assert snapshots.get() == 3


def test_request_places():
    places = readiness.RequestPlaces(limit=1, clock=Clock())
    with places.place() as first, places.place() as second:
        assert first and not second
    with places.place() as again:
        assert again
    answer = places.refusal("r", 3)
    assert answer["status"] == 429 and json.loads(answer["body"])["error"] == "LIMITS_ENFORCED" and places.refusal("r") is answer


def test_reports(spark):
    app = spark.createDataFrame([("DEGRADED",)], "state string")
    routes = spark.createDataFrame([("b", "READY"), ("a", "DEGRADED")], "route string, state string")
    endpoints = spark.createDataFrame([("e", "CB_OPEN")], "endpoint string, state string")
    report = readiness.management(app, routes, endpoints)
    assert report["ready"][0] == 200 and list(report["status"][1]["routes"]) == ["a", "b"] and report["live"][0] == 200
    down = readiness.management(spark.createDataFrame([("NOT_READY",)], "state string"), routes, endpoints)
    assert down["ready"] == (503, {"state": "NOT_READY"})
    gauges = health.state_gauge(routes, readiness.ROUTE_GAUGE).drop("state")
    text = readiness.exposition({"route_state": gauges}, "gauge")
    assert text == '# TYPE route_state gauge\nroute_state{route="a"} 3\nroute_state{route="b"} 1\n'


def test_gate_by_hand():
    gate = health.Gate(1, 0)
    assert [gate.arrive(t, d)[0] for t, d in [(0, 10), (1, 5), (2, 5), (10, 1)]] == ["admitted", "rejected", "rejected", "admitted"]
    queued = health.Gate(1, 1)
    assert queued.arrive(0, 10) == ("admitted", 0, 0)
    assert queued.arrive(1, 5) == ("queued", 10, 1)
    assert queued.arrive(2, 5) == ("rejected", None, 1)
    assert queued.arrive(12, 1) == ("queued", 15, 1)
    assert queued.arrive(20, 1) == ("admitted", 20, 0)


def test_application_without_routes(spark):
    none = spark.createDataFrame([], "route string, state string, priority int, ordinal int")
    assert health.app_state(none).first().state == "READY" and health.app_state(none, 2).first().state == "READY"


def test_every_error_kind_has_a_layer():
    assert errors.layer_of("MissingPath") == "expression" and errors.layer_of("Transport") == "handler" and errors.layer_of("none") is None
