"""Route documents: parsing, validation with all errors at once, merged limits."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from weirflow.config import rules
from weirflow.config.options import expand
from weirflow.config.rules import duration_ms, duration_range

__all__ = ["Document", "InvalidDocument", "Phase", "Route", "duration_ms", "duration_range", "load"]

#: Phase types and the connector kind that each needs (None: no connector).
PHASES: dict[str, str | None] = {
    "transform": None, "serialize": None, "parallel": None, "kafka_producer": "kafka",
    "http_client": "http_client", "grpc_client": "grpc", "rabbitmq": "rabbitmq", "mqtt": "mqtt",
    "smtp_send": "smtp", "mariadb_idempotent_insert": "mariadb", "postgres_idempotent_insert": "postgres",
    "mongodb": "mongodb", "redis": "redis",
}
KINDS = {
    "kafka", "rabbitmq", "mqtt", "mongodb", "redis", "smtp", "postgres", "mariadb", "http_server",
    "http_client", "grpc",
}
#: Options that a phase must have, besides its connector.
REQUIRED = {
    "serialize": ("codec",), "kafka_producer": ("topic",), "mqtt": ("topic",), "mariadb_idempotent_insert": ("key",),
    "postgres_idempotent_insert": ("sql",), "mongodb": ("collection", "operation"), "redis": ("command",),
}
MONGO_OPERATIONS = {
    "insert_one": {"document"}, "replace_one": {"filter", "document"}, "update_one": {"filter", "update"},
    "delete_one": {"filter"}, "aggregate": {"pipeline"},
}
TOP_LEVEL = ("api_version", "app", "connectors", "management")
JITTERS = rules.JITTERS
# The budget of an application that states none, in ms.
DEFAULT_BUDGET = {"max_attempts": 5, "max_elapsed": 30_000, "base_backoff": 50, "max_backoff": 5_000, "jitter": "full"}


@dataclass
class Connector:
    name: str
    kind: str
    options: dict[str, Any] = field(default_factory=dict)
    settings: dict[str, Any] = field(default_factory=dict)


@dataclass
class Phase:
    name: str
    kind: str
    options: dict[str, Any]
    connector: str | None = None
    timeout_ms: int | None = None


@dataclass
class Route:
    name: str
    trigger: Connector | None
    trigger_options: dict[str, Any]
    phases: list[Phase]
    policy: dict[str, Any]

    @property
    def fallbacks(self) -> dict[str, str]:
        return dict(self.policy.get("fallback", {}))

    def main_phases(self) -> list[Phase]:
        """Phases in slot order; fallback phases are taken out, which renumbers slots."""
        out = set(self.fallbacks.values())
        return [p for p in self.phases if p.name not in out]

    def fallback_phases(self) -> list[Phase]:
        by_name = {p.name: p for p in self.phases}
        return [by_name[n] for n in sorted(set(self.fallbacks.values())) if n in by_name]

    def requires(self) -> list[str]:
        """Connectors the route depends on: as stated, else those of its phases."""
        stated = self.policy.get("requires")
        if stated is not None:
            return sorted(set(stated))
        found: set[str] = set()
        for phase in self.phases:
            found |= {phase.connector} if phase.connector else set()
            for child in phase.options.get("phases", ()) if phase.kind == "parallel" else ():
                name = child.get("options", {}).get("connector", child.get("connector"))
                found |= {name} if name else set()
        return sorted(found)


@dataclass
class Document:
    connectors: dict[str, Connector]
    routes: dict[str, Route]
    app: dict[str, Any]
    management: dict[str, Any] | None = None

    def budget(self, route: Route) -> dict[str, Any]:
        """The route's budget within those of the application and its connectors; durations in ms."""
        own = [self.connectors[n].settings.get("retry_budget") for n in route.requires() if n in self.connectors]
        return merge_budgets(DEFAULT_BUDGET | budget_ms(self.app.get("retry_budget")), *map(budget_ms, own), budget_ms(route.policy.get("retry_budget")))

    def limits(self, route: Route) -> dict[str, Any]:
        """The application's limits of routes, overridden by the route's own."""
        return merge_limits((self.app.get("limits") or {}).get("routes"), route.policy.get("limits"))


class InvalidDocument(ValueError):
    """A document with errors; ``errors`` has all of them."""

    def __init__(self, errors: list[str]):
        super().__init__("\n".join(errors))
        self.errors = errors


def budget_ms(raw: dict[str, Any] | None) -> dict[str, Any]:
    """A retry budget with durations in ms."""
    names = ("max_elapsed", "base_backoff", "max_backoff")
    return {k: duration_ms(v) if k in names else v for k, v in (raw or {}).items() if v is not None}


def merge_budgets(*budgets: dict[str, Any] | None) -> dict[str, Any]:
    """The strictest of several retry budgets: least bounds, greatest base, most jitter; unset parts are left out."""
    rules = {"max_attempts": min, "max_elapsed": min, "base_backoff": max, "max_backoff": min}
    out: dict[str, Any] = {}
    for key, rule in rules.items():
        values = [b[key] for b in budgets if b and b.get(key) is not None]
        if values:
            out[key] = rule(values)
    ranks = [JITTERS.index(b["jitter"]) for b in budgets if b and b.get("jitter") in JITTERS]
    return out | ({"jitter": JITTERS[max(ranks)]} if ranks else {})


def merge_limits(app: dict[str, Any] | None, route: dict[str, Any] | None) -> dict[str, Any]:
    """Limits of the application, field by field overridden by the route's."""
    return {**(app or {}), **{k: v for k, v in (route or {}).items() if v is not None}}


def _options(where: str, raw: Any, errors: list[str]) -> dict[str, Any]:
    """Dotted options as a tree."""
    try:
        tree = expand(raw or {})
    except ValueError as error:
        errors.append(f"{where}: {error}")
        return {}
    return tree if isinstance(tree, dict) else {"value": tree}


def _connectors(raw: Any, errors: list[str]) -> dict[str, Connector]:
    found: dict[str, Connector] = {}
    for i, item in enumerate(raw or []):
        name, kind = item.get("name"), item.get("type")
        if not name:
            errors.append(f"connectors[{i}]: a name is missing")
            continue
        options = _options(f"connector {name}", item.get("options"), errors)
        if kind == "http":
            role = str(options.get("role", item.get("role", ""))).lower()
            if role not in ("server", "client"):
                errors.append(f"connector {name}: an http connector needs the role server or client")
            kind = f"http_{role}"
        if name in found:
            errors.append(f"connector {name}: the name is taken")
        errors += rules.breaker(name, item.get("cb"))
        errors += rules.budget(f"connector {name}: retry_budget", item.get("retry_budget"))
        errors += rules.tls(name, kind, options)
        found[name] = Connector(name, str(kind), options, {k: v for k, v in item.items() if k not in ("name", "type", "options")})
    return found


def _timeout(where: str, item: dict, options: dict, errors: list[str]) -> int | None:
    stated = (item.get("timeout"), options.pop("timeout", None), options.pop("timeout_ms", None), item.get("timeout_ms"))
    given = [x for x in stated if x is not None]
    if len(given) > 1:
        errors.append(f"{where}: the timeout is given twice")
    elif given:
        try:
            return duration_ms(given[0])
        except ValueError as error:
            errors.append(f"{where}: {error}")
    return None


def _children(where: str, options: dict, errors: list[str]) -> None:
    """A parallel phase's children."""
    children = options.get("phases") or []
    if not children:
        errors.append(f"{where}: children are missing")
    if any(c.get("type") == "parallel" for c in children):
        errors.append(f"{where}: parallel phases cannot be nested")
    known = {"name", "type", "options", "connector", "optional", "fallback", "timeout", "timeout_ms"}
    for child in children:
        for key in sorted(set(child) - known):
            errors.append(f"{where}, child {child.get('name')}: unknown key {key}")
    mode, quorum = options.get("aggregation", "all"), options.get("quorum")
    if mode not in ("all", "any", "quorum"):
        errors.append(f"{where}: unknown aggregation {mode}")
    if quorum is not None and not 1 <= int(quorum) <= max(1, len(children)):
        errors.append(f"{where}: the quorum must lie between 1 and {len(children)}")


def _phase(route: str, i: int, item: dict, connectors: dict[str, Connector], errors: list[str]) -> Phase:
    where, kind = f"route {route}, phase {item.get('name', i)}", str(item.get("type"))
    options = _options(where, item.get("options"), errors)
    connector = options.pop("connector", item.get("connector"))
    timeout = _timeout(where, item, options, errors)
    phase = Phase(str(item.get("name", i)), kind, options, connector, timeout)
    wanted = PHASES.get(kind)
    if wanted:
        if not connector:
            errors.append(f"{where}: a connector is missing")
        elif connector not in connectors:
            errors.append(f"{where}: unknown connector {connector}")
        elif connectors[connector].kind in KINDS and connectors[connector].kind != wanted:
            errors.append(f"{where}: connector {connector} is of type {connectors[connector].kind}, not {wanted}")
    for name in REQUIRED.get(kind, ()):
        if options.get(name) in (None, ""):
            errors.append(f"{where}: option {name} is missing")
    if kind == "smtp_send" and not any(options.get(k) for k in ("to", "cc", "bcc")):
        errors.append(f"{where}: a recipient is missing")
    if kind == "mongodb":
        need = MONGO_OPERATIONS.get(options.get("operation"))
        if need is None:
            errors.append(f"{where}: unknown operation {options.get('operation')}")
        elif need - set(options):
            errors.append(f"{where}: {options['operation']} needs {', '.join(sorted(need))}")
    if kind == "parallel":
        _children(where, options, errors)
    return phase


def _policy(route: Route, connectors: dict[str, Connector], app: dict[str, Any], errors: list[str]) -> None:
    where, policy = f"route {route.name}", route.policy
    names = {p.name for p in route.phases}
    for failed, phase in (policy.get("fallback") or {}).items():
        if failed not in connectors:
            errors.append(f"{where}: fallback for an unknown connector {failed}")
        elif connectors[failed].kind in KINDS and connectors[failed].kind not in rules.BROKERS:
            errors.append(f"{where}: fallback connector {failed} is no broker")
        if phase not in names:
            errors.append(f"{where}: unknown fallback phase {phase}")
    before = len(errors)
    errors += rules.budget(f"{where}: retry_budget", policy.get("retry_budget"))
    errors += rules.limits(f"{where}: limits", policy.get("limits"))
    retries = (policy.get("delivery") or {}).get("retries")
    if retries is not None and len(errors) == before:
        try:
            allowed = Document(connectors, {}, app).budget(route).get("max_attempts")
            if allowed is not None and retries + 1 > allowed:
                errors.append(f"{where}: {retries} retries exceed the budget of {allowed} attempts")
        except ValueError:
            pass  # a budget elsewhere is wrong, which is reported there
    outer = (app.get("limits") or {}).get("routes") or {}
    for name in ("max_inflight", "max_queue_depth"):
        own = (policy.get("limits") or {}).get(name)
        if own is not None and outer.get(name) is not None and own > outer[name]:
            errors.append(f"{where}: {name} exceeds that of the application")


def _routes_key(raw: dict[str, Any]) -> str:
    """The section that holds the routes: a list of items with a trigger, whatever it is called."""
    for key, value in raw.items():
        if key not in TOP_LEVEL and isinstance(value, list) and value and all(isinstance(x, dict) and "trigger" in x for x in value):
            return key
    return "routes"


def _management(section: dict[str, Any] | None) -> dict[str, Any] | None:
    """Host, port and paths of the management endpoints; ``health`` stands for ``live``."""
    if section is None or section.get("port") is None:
        return None
    asked = {n: section[n] for n in ("live", "ready", "status", "metrics") if n in section}
    if "live" not in asked and "health" in section:
        asked["live"] = section["health"]
    if not asked:
        return None
    paths = {n: ((e or {}).get("path") or "").strip() or f"/{n}" for n, e in asked.items()}
    host = str(section.get("host") or "").strip() or "0.0.0.0"
    return {"host": host, "port": section["port"]} | {n: p if p.startswith("/") else f"/{p}" for n, p in paths.items()}


def load(raw: dict[str, Any] | str) -> Document:
    """A document from a mapping or YAML text; raises :class:`InvalidDocument` with all errors.

    Unknown phase types and connector kinds load; a phase of an unknown type
    fails on each event.
    """
    if isinstance(raw, str):
        import yaml

        documents = list(yaml.safe_load_all(raw))
        if len(documents) != 1 or not isinstance(documents[0], dict):
            raise InvalidDocument([f"expected one document, found {len(documents)}"])
        raw = documents[0]
    section = _routes_key(raw)
    errors = [f"unknown key {key}" for key in sorted(set(raw) - {*TOP_LEVEL, section})]
    if str(raw.get("api_version", "")).strip().lower() != "v1":
        errors.append("api_version must be v1")
    app = raw.get("app") or {}
    errors += rules.app(app)
    errors += rules.management(raw.get("management"))
    connectors = _connectors(raw.get("connectors"), errors)
    routes: dict[str, Route] = {}
    for item in raw.get(section) or []:
        name = item.get("name", "")
        if not name or name in routes:
            errors.append(f"route {name!r}: the name is missing or taken")
        trigger = item.get("trigger") or {}
        source = connectors.get(trigger.get("connector"))
        options = _options(f"route {name}: trigger", trigger.get("options"), errors)
        if source is None:
            errors.append(f"route {name}: unknown trigger connector {trigger.get('connector')}")
        else:
            errors += rules.trigger(name, source.kind, options, trigger.get("kafka"))
        options |= dict(trigger.get("kafka") or {})
        phases = [_phase(name, i, p, connectors, errors) for i, p in enumerate(item.get("phases") or [])]
        routes[name] = Route(name, source, options, phases, item.get("policy") or {})
        _policy(routes[name], connectors, app, errors)
    errors += rules.gates(app.get("feature_flags"), connectors, routes)
    if errors:
        raise InvalidDocument(errors)
    return Document(connectors, routes, app, _management(raw.get("management")))
