"""Documents: what loads, what is refused, and how parts are merged."""

import copy

import pytest
import yaml

from weirflow.config import connectors, loader, options, rules
from weirflow.config.loader import InvalidDocument, load

BASE = """
api_version: v1
app: {feature_flags: [rabbitmq, mqtt, mongodb, redis, parallel_phase, serialize_phase]}
connectors:
  - {name: door, type: http, options: {role: server, port: 1}}
  - {name: web, type: http, options: {role: client, base_url: "http://web.example"}}
  - {name: bus, type: kafka, options: {brokers: "a:1, b:2"}}
  - {name: mq, type: rabbitmq, options: {url: "amqp://mq"}}
  - {name: iot, type: mqtt, options: {url: "mqtt://iot"}}
  - {name: doc, type: mongodb, options: {url: "mongodb://doc", database: d}}
  - {name: kv, type: redis, options: {url: "redis://kv"}}
flows:
  - name: one
    trigger: {connector: door, options: {method: POST, path: /a}}
    phases:
      - {name: shape, type: transform, options: {a.b.0: ".[0].x", a.b.1: 2}}
      - {name: send, type: kafka_producer, options: {connector: bus, topic: t}}
"""


def errors_of(change) -> list[str]:
    raw = copy.deepcopy(yaml.safe_load(BASE))
    change(raw)
    with pytest.raises(InvalidDocument) as caught:
        load(raw)
    return caught.value.errors


def test_loads_with_any_name_of_the_routes_section():
    document = load(BASE)
    assert list(document.routes) == ["one"] and document.routes["one"].requires() == ["bus"]
    assert document.routes["one"].phases[0].options == {"a": {"b": [".[0].x", 2]}}
    assert document.connectors["door"].kind == "http_server"
    assert document.budget(document.routes["one"]) == loader.DEFAULT_BUDGET


def test_all_errors_at_once():
    def change(raw):
        raw["api_version"] = "v2"
        raw["extra"] = 1
        raw["flows"][0]["trigger"]["connector"] = "nowhere"
        raw["flows"][0]["phases"][1]["options"]["connector"] = "web"
        raw["app"]["readiness_cache"] = "10ms"

    found = errors_of(change)
    assert len(found) == 5
    for word in ("api_version", "unknown key extra", "nowhere", "http_client, not kafka", "50ms"):
        assert any(word in e for e in found), (word, found)


def _set(path, value):
    def change(raw):
        node = raw
        for key in path[:-1]:
            node = node[key]
        node[path[-1]] = value

    return change


ROUTE = ("flows", 0)
CASES = [
    (("app", "min_ready_routes"), 0, "min_ready_routes"),
    (("app", "half_open_counts_as_ready"), "often", "half_open"),
    (("app", "warmup_timeout"), "soon", "warmup_timeout"),
    (("app", "limits"), {"routes": {"overflow_policy": "queue"}}, "max_queue_depth is missing"),
    (("app", "limits"), {"routes": {"max_inflight": 0}}, "max_inflight must be greater"),
    (("app", "limits"), {"routes": {"overflow_policy": "drop"}}, "overflow_policy must be one of"),
    (("app", "retry_budget"), {"max_backoff": "20s", "max_elapsed": "10s"}, "max_backoff must not exceed max_elapsed"),
    (("app", "retry_budget"), {"base_backoff": "2s", "max_backoff": "1s"}, "base_backoff must not exceed"),
    (("app", "retry_budget"), {"jitter": "some"}, "jitter must be one of"),
    (("app", "retry_budget"), {"max_attempts": 0}, "max_attempts must be greater"),
    (("app", "feature_flags"), ["rabbitmq", "mqtt", "mongodb", "redis", "warp"], "no feature warp"),
    (("app", "feature_flags"), ["mqtt", "mongodb", "redis"], "rabbitmq needs its feature flag"),
    (("connectors", 1, "cb"), {"failure_rate": 0.5, "window": "1s", "open_base": "2s", "open_max": "1s"}, "open_max must not be less"),
    (("connectors", 1, "cb"), {"failure_rate": 1.5, "window": "1s", "open_base": "1s", "open_max": "1s"}, "failure_rate must lie"),
    (("connectors", 1, "cb"), {"failure_rate": 0.5}, "cb.window is missing"),
    (("connectors", 1, "name"), "door", "the name is taken"),
    (("connectors", 1, "options", "role"), "both", "needs the role"),
    (("connectors", 1, "options", "base_url"), "https://web", "https:// needs tls"),
    (("connectors", 1, "options"), {"role": "client", "base_url": "https://w", "tls": {"cert": "c", "key": "k"}}, "needs tls.ca"),
    (("connectors", 1, "options"), {"role": "client", "base_url": "http://w", "tls": {"cert": "c", "key": "k"}}, "client certificates need"),
    (("connectors", 0, "options"), {"role": "server", "port": 1, "tls.cert": "c"}, "belong together"),
    (("connectors", 0, "options"), {"role": "server", "port": 1, "tls.ca": "c"}, "needed to listen"),
    (("connectors", 2, "options", "sasl"), {"mechanism": "PLAIN", "username": "u", "password": "p"}, "sasl needs tls"),
    (("connectors", 2, "options", "brokers"), "ssl://a:1", "ssl:// brokers"),
    (("connectors", 3, "options", "tls"), {"cert": "c", "key": "-----BEGIN KEY"}, "must be a path"),
    (("connectors", 4, "options", "url"), "mqtts://iot", "mqtts:// needs tls"),
    ((*ROUTE, "trigger"), {"connector": "web"}, "must be a server"),
    ((*ROUTE, "trigger"), {"connector": "bus"}, "topic is missing"),
    ((*ROUTE, "trigger"), {"connector": "bus", "kafka": {"topic": "t"}}, "group_id is missing"),
    ((*ROUTE, "trigger"), {"connector": "mq", "kafka": {"topic": "t"}}, "kafka options on a rabbitmq"),
    ((*ROUTE, "trigger"), {"connector": "mq", "options": {}}, "queue is missing"),
    ((*ROUTE, "trigger"), {"connector": "iot", "options": {"queue": "q"}}, "a queue on a mqtt"),
    ((*ROUTE, "trigger"), {"connector": "door", "options": {"codec": "cbor"}}, "no codec"),
    ((*ROUTE, "trigger"), {"connector": "door", "options": {"retry_max": "1s"}}, "retry_max is not supported"),
    ((*ROUTE, "trigger"), {"connector": "iot", "options": {"topic": "t", "retry_initial": "2s", "retry_max": "1s"}}, "retry_max must not"),
    ((*ROUTE, "trigger"), {"connector": "iot", "options": {"topic": "t", "retry_multiplier": 99}}, "between 1.1 and 10"),
    ((*ROUTE, "trigger"), {"connector": "iot", "options": {"topic": "t", "retry_max_ms": 5}}, "out of use"),
    ((*ROUTE, "trigger"), {"connector": "kv", "options": {"mode": "pubsub"}}, "channels is missing"),
    ((*ROUTE, "trigger"), {"connector": "kv", "options": {}}, "stream is missing"),
    ((*ROUTE, "trigger"), {"connector": "doc", "options": {"database": "d"}}, "collection is missing"),
    ((*ROUTE, "phases", 1, "options"), {"connector": "bus"}, "option topic is missing"),
    ((*ROUTE, "phases", 1, "timeout"), "0s", "greater than 0"),
    ((*ROUTE, "phases", 1), {"name": "p", "type": "parallel", "options": {"phases": []}}, "children are missing"),
    ((*ROUTE, "phases", 1), {"name": "p", "type": "parallel", "options": {"phases": [{"name": "c", "type": "parallel"}]}}, "cannot be nested"),
    ((*ROUTE, "phases", 1), {"name": "p", "type": "parallel", "options": {"quorum": 3, "phases": [{"name": "c", "type": "transform"}]}}, "quorum must lie"),
    ((*ROUTE, "phases", 1), {"name": "p", "type": "parallel", "options": {"phases": [{"name": "c", "kind": "x"}]}}, "unknown key kind"),
    ((*ROUTE, "phases", 1), {"name": "m", "type": "mongodb", "options": {"connector": "doc", "collection": "c", "operation": "update_one"}}, "needs filter, update"),
    ((*ROUTE, "phases", 1), {"name": "m", "type": "smtp_send", "options": {"connector": "bus"}}, "a recipient is missing"),
    ((*ROUTE, "policy"), {"fallback": {"web": "send"}}, "web is no broker"),
    ((*ROUTE, "policy"), {"fallback": {"bus": "none"}}, "unknown fallback phase"),
    ((*ROUTE, "policy"), {"delivery": {"retries": 5}}, "exceed the budget of 5"),
    (("management",), {"live": {}}, "management.port is missing"),
    (("management",), {"port": 1, "pulse": {}}, "unknown key pulse"),
]


@pytest.mark.parametrize(("path", "value", "wanted"), CASES, ids=[c[2][:40] for c in CASES])
def test_rule(path, value, wanted):
    found = errors_of(_set(path, value))
    assert any(wanted in e for e in found), found


def test_limits_within_the_application():
    def change(raw):
        raw["app"]["limits"] = {"routes": {"max_inflight": 4}}
        raw["flows"][0]["policy"] = {"limits": {"max_inflight": 5}}

    assert errors_of(change) == ["route one: max_inflight exceeds that of the application"]


def test_timeout_given_twice():
    assert any("twice" in e for e in errors_of(_set((*ROUTE, "phases", 1), {"name": "s", "type": "transform", "timeout": "1s", "timeout_ms": 5})))


def test_unknown_phase_types_load():
    raw = yaml.safe_load(BASE)
    raw["flows"][0]["phases"].append({"name": "odd", "type": "teleport", "options": {}})
    assert load(raw).routes["one"].phases[2].kind == "teleport"


def test_management_paths():
    raw = yaml.safe_load(BASE) | {"management": {"port": 9, "host": " ", "health": {"path": "up"}, "metrics": {}}}
    assert load(raw).management == {"host": "0.0.0.0", "port": 9, "live": "/up", "metrics": "/metrics"}


def test_more_than_one_document():
    with pytest.raises(InvalidDocument):
        load(BASE + "\n---\na: 1\n")


@pytest.mark.parametrize(
    ("text", "ms"), [("250ms", 250), ("1m 30s", 90_000), ("2weeks", 1_209_600_000), ("3 hours 5 min", 11_100_000), (7, 7), ("12", 12)]
)
def test_durations(text, ms):
    assert rules.duration_ms(text) == ms


def test_durations_that_are_none():
    for text in ("", "soon", "5 fortnights", "-1s", True, None, 0, "0s", 1.5):
        with pytest.raises(ValueError):
            rules.duration_ms(text)
    assert rules.duration_range("1s..5s") == (1000, 5000)
    with pytest.raises(ValueError):
        rules.duration_range("5s..1s")


def test_budgets_and_limits_merge():
    merged = loader.merge_budgets({"max_attempts": 5, "base_backoff": 10, "jitter": "none"}, None, {"max_attempts": 3, "base_backoff": 40, "jitter": "full"})
    assert merged == {"max_attempts": 3, "base_backoff": 40, "jitter": "full"}
    assert loader.merge_limits({"a": 1, "b": 2}, {"b": None, "a": 3}) == {"a": 3, "b": 2}


def test_dotted_options():
    flat = {"a.b.0": 1, "a.b.1": 2, "a.c": {"d.e": 3}}
    tree = options.expand(flat)
    assert tree == {"a": {"b": [1, 2], "c": {"d": {"e": 3}}}}
    assert options.flatten(tree) == {"a.b.0": 1, "a.b.1": 2, "a.c.d.e": 3}
    for wrong in ({"a": 1, "a.b": 2}, {"a.b": 1, "a": {"b": 2}} | {"a.b.c": 3}):
        with pytest.raises(ValueError):
            options.expand(wrong)


def test_connector_handles():
    registry = connectors.Registry(load(BASE).connectors)
    bus = registry.get("bus", "kafka")
    assert bus["brokers"] == ["a:1", "b:2"] and bus["create_topics_if_missing"] is False and registry.get("bus") is bus
    assert registry.get("doc")["uri"] == "mongodb://doc"
    assert registry.counts()["http_client"] == 1
    for name, kind in (("bus", "mqtt"), ("none", None)):
        with pytest.raises(LookupError):
            registry.get(name, kind)
    smtp = connectors.handle("m", "smtp", {"host": "h", "auth": {"username": "u", "password": "p", "x": 1}, "own": True})
    assert smtp["port"] == 587 and smtp["auth"]["extra"] == {"x": 1} and smtp.extra == {"own": True}
    wrong = [
        ("kafka", {}), ("http_server", {"port": "many"}), ("kafka", {"brokers": " , "}), ("redis", {"url": "r", "pool": 5}),
        ("smtp", {"host": "h", "auth": {"username": "u"}}), ("postgres", {}), ("teleport", {}), ("mqtt", {"url": "m", "keep_alive": -1}),
    ]
    for kind, given in wrong:
        with pytest.raises(connectors.OptionError):
            connectors.handle("c", kind, given)
    for kind, given in {
        "rabbitmq": {"url": "u", "prefetch": "5"}, "mqtt": {"url": "u", "client_id": 7}, "redis": {"url": "u", "pool": {"min_idle": 1}},
        "postgres": {"url": "u", "schema": "s"}, "mariadb": {"url": "u", "pool": {"max_connections": 4}}, "grpc": {"endpoint": "e", "metadata": {"k": "v"}},
        "http_client": {"base_url": "b", "default_headers": {"h": "v"}}, "http_server": {"port": 80, "health": {"path": "/up"}},
    }.items():
        assert connectors.handle("c", kind, given).kind == kind
