"""Typed options of the eleven connector kinds; what a kind does not know is kept as ``extra``."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Option:
    """An option: its type, whether it must be there, its default and other names."""

    kind: type | dict
    required: bool = False
    default: Any = None
    aliases: tuple[str, ...] = ()


class _List(list):
    """Marks comma-separated text or a list."""


_TEXT, _NUMBER, _FLAG = Option(str), Option(int), Option(bool)
_TLS = {"ca": _TEXT, "cert": _TEXT, "key": _TEXT}
_DB_POOL = {"max_connections": _NUMBER, "idle_timeout_secs": _NUMBER}

# Names, defaults and nesting of each kind's options.
OPTIONS: dict[str, dict[str, Option]] = {
    "kafka": {
        "brokers": Option(_List, True), "create_topics_if_missing": Option(bool, default=False), "tls": Option(_TLS),
        "sasl": Option({"mechanism": Option(str, True), "username": Option(str, True), "password": Option(str, True)}),
        "topic": Option({"partitions": _NUMBER, "replication_factor": _NUMBER}),
    },
    "rabbitmq": {"url": Option(str, True), "prefetch": _NUMBER, "tls": Option(_TLS)},
    "mqtt": {
        "url": Option(str, True), "client_id": _TEXT, "username": _TEXT, "password": _TEXT, "keep_alive": _NUMBER,
        "tls": Option(_TLS),
    },
    "mongodb": {
        "uri": Option(str, True, aliases=("url",)), "database": Option(str, True), "tls": Option(_TLS),
        "options": Option(object),
    },
    "redis": {
        "url": Option(str, True), "cluster": _FLAG, "tls": Option(_TLS),
        "pool": Option({"max_connections": _NUMBER, "min_idle": _NUMBER, "idle_timeout_secs": _NUMBER}),
    },
    "smtp": {
        "host": Option(str, True), "port": Option(int, default=587), "from": _TEXT, "timeout_secs": _NUMBER,
        "auth": Option({"username": Option(str, True), "password": Option(str, True), "mechanism": _TEXT}),
        "tls": Option(_TLS | {"mode": _TEXT, "domain": _TEXT}),
    },
    "postgres": {"url": Option(str, True), "schema": _TEXT, "tls": Option(_TLS | {"mode": _TEXT})},
    "mariadb": {
        "url": Option(str, True), "schema": _TEXT, "pool": Option(_DB_POOL), "tls": Option(_TLS | {"mode": _TEXT}),
        "table": _TEXT, "key_column": Option(str, default="record_key"), "value_column": Option(str, default="payload"),
    },
    "http_server": {
        "host": Option(str, default="0.0.0.0"), "port": Option(int, True), "tls": Option(_TLS),
        "health": Option({"method": _TEXT, "path": _TEXT}),
    },
    "http_client": {
        "base_url": Option(str, True), "tls": Option(_TLS), "default_headers": Option(object),
        "pool": Option({"max_idle_per_host": _NUMBER, "idle_timeout_secs": _NUMBER}),
    },
    "grpc": {
        "endpoint": Option(str, True), "tls": Option(_TLS | {"domain": _TEXT}), "descriptor": _TEXT,
        "metadata": Option(object, default={}),
    },
}


class OptionError(ValueError):
    """An option that is missing or of the wrong type."""


@dataclass
class Handle:
    """A connector's options as its clients take them."""

    name: str
    kind: str
    values: dict[str, Any]
    extra: dict[str, Any] = field(default_factory=dict)

    def __getitem__(self, key: str) -> Any:
        return self.values[key]


def _read(value: Any, option: Option, where: str) -> Any:
    if isinstance(option.kind, dict):
        if not isinstance(value, dict):
            raise OptionError(f"{where} must hold options")
        known, extra = _fields(value, option.kind, where)
        return known | ({"extra": extra} if extra else {})
    if option.kind is _List:
        items = value.split(",") if isinstance(value, str) else value
        if not isinstance(items, list):
            raise OptionError(f"{where} must be text or a list")
        items = [str(x).strip() for x in items if str(x).strip()]
        if not items:
            raise OptionError(f"{where} is empty")
        return items
    if option.kind is str and isinstance(value, int | float) and not isinstance(value, bool):
        return str(value)
    if option.kind is object:
        return value
    if option.kind is int and isinstance(value, str) and value.strip().isdigit():
        return int(value)
    if not isinstance(value, option.kind) or (option.kind is int and isinstance(value, bool)):
        raise OptionError(f"{where} must be of type {option.kind.__name__}")
    if option.kind is int and value < 0:
        raise OptionError(f"{where} must not be negative")
    return value


def _fields(raw: dict[str, Any], spec: dict[str, Option], where: str) -> tuple[dict[str, Any], dict[str, Any]]:
    known: dict[str, Any] = {}
    used: set[str] = set()
    for name, option in spec.items():
        given = next((n for n in (name, *option.aliases) if raw.get(n) is not None), None)
        if given is None:
            if option.required:
                raise OptionError(f"{where}.{name} is missing")
            known[name] = option.default
        else:
            used.add(given)
            known[name] = _read(raw[given], option, f"{where}.{name}")
    return known, {k: v for k, v in raw.items() if k not in used and raw[k] is not None}


def handle(name: str, kind: str, options: dict[str, Any]) -> Handle:
    """The typed options of a connector; raises :class:`OptionError`."""
    if kind not in OPTIONS:
        raise OptionError(f"connector {name}: there is no kind {kind}")
    values, extra = _fields(options, OPTIONS[kind], f"connector {name}")
    return Handle(name, kind, values, extra)


class Registry:
    """Connectors by name; handles are built on first use and kept."""

    def __init__(self, connectors: dict[str, Any]):
        self._connectors, self._handles = connectors, {}

    def get(self, name: str, kind: str | None = None) -> Handle:
        """The handle of a name, of the given kind; raises ``LookupError`` or :class:`OptionError`."""
        connector = self._connectors.get(name)
        if connector is None:
            raise LookupError(f"there is no connector {name}")
        if kind and connector.kind != kind:
            raise LookupError(f"connector {name} is of kind {connector.kind}, not {kind}")
        if name not in self._handles:
            self._handles[name] = handle(name, connector.kind, connector.options)
        return self._handles[name]

    def counts(self) -> dict[str, int]:
        """How many connectors there are of each kind."""
        out: dict[str, int] = {}
        for c in self._connectors.values():
            out[c.kind] = out.get(c.kind, 0) + 1
        return dict(sorted(out.items()))
