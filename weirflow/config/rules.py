"""Checks of a parsed document; each yields the errors that it finds."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from weirflow.functions.scalars import duration_ms as text_ms

# Names, gates and bounds of the format.
FEATURES = ("rabbitmq", "mqtt", "mongodb", "redis", "parallel_phase", "serialize_phase")
GATED_KINDS = ("rabbitmq", "mqtt", "mongodb", "redis")
GATED_PHASES = {"parallel": "parallel_phase", "serialize": "serialize_phase"}
POLLING = ("kafka", "rabbitmq", "mqtt", "redis", "mongodb")
BROKERS = ("kafka", "rabbitmq", "mqtt")
JITTERS = ("none", "equal", "full")
OVERFLOW = ("reject", "queue", "shed")
HALF_OPEN = ("never", "endpoint", "route")
#: Address option and the scheme that asks for TLS, for kinds that must then trust a ca.
SECURE = {
    "http_client": ("base_url", "https://"), "grpc": ("endpoint", "https://"), "rabbitmq": ("url", "amqps://"),
    "mqtt": ("url", "mqtts://"), "redis": ("url", "rediss://"),
}


def duration_ms(value: Any) -> int:
    """Milliseconds of a positive integer or of text such as ``1m 30s``."""
    ms: float | None = None
    if isinstance(value, int) and not isinstance(value, bool):
        ms = value
    elif isinstance(value, str):
        ms = int(value) if value.strip().isdigit() else text_ms(value)
    if ms is None:
        raise ValueError(f"{value!r} is no duration")
    if ms <= 0:
        raise ValueError(f"{value!r} must be greater than 0")
    return int(ms) if ms >= 1 else 1


def duration_range(value: Any) -> tuple[int, int]:
    """Least and greatest of ``min..max``; a single duration is both."""
    low, dots, high = str(value).partition("..")
    bounds = (duration_ms(low), duration_ms(high)) if dots else (duration_ms(value),) * 2
    if bounds[0] > bounds[1]:
        raise ValueError(f"{value!r} ends before it begins")
    return bounds


def _durations(where: str, section: dict[str, Any], names: tuple[str, ...], found: dict[str, int]) -> Iterator[str]:
    for name in names:
        if section.get(name) is not None:
            try:
                found[name] = duration_ms(section[name])
            except ValueError as error:
                yield f"{where}.{name}: {error}"


def budget(where: str, section: dict[str, Any] | None) -> Iterator[str]:
    """A retry budget: positive parts, base <= greatest backoff <= elapsed, a known jitter."""
    if not section:
        return
    ms: dict[str, int] = {}
    yield from _durations(where, section, ("max_elapsed", "base_backoff", "max_backoff"), ms)
    if section.get("max_attempts") is not None and section["max_attempts"] < 1:
        yield f"{where}.max_attempts must be greater than 0"
    if section.get("jitter") is not None and str(section["jitter"]).strip().lower() not in JITTERS:
        yield f"{where}.jitter must be one of {', '.join(JITTERS)}"
    for low, high in (("base_backoff", "max_backoff"), ("max_backoff", "max_elapsed")):
        if low in ms and high in ms and ms[low] > ms[high]:
            yield f"{where}.{low} must not exceed {high}"


def limits(where: str, section: dict[str, Any] | None) -> Iterator[str]:
    """Limits of routes: positive bounds, a known overflow policy, a depth for a queue."""
    if not section:
        return
    for name in ("max_inflight", "max_queue_depth"):
        if section.get(name) is not None and section[name] < 1:
            yield f"{where}.{name} must be greater than 0"
    policy = section.get("overflow_policy")
    if policy is not None and str(policy).strip().lower() not in OVERFLOW:
        yield f"{where}.overflow_policy must be one of {', '.join(OVERFLOW)}"
    elif policy is not None and str(policy).strip().lower() == "queue" and section.get("max_queue_depth") is None:
        yield f"{where}.max_queue_depth is missing for the policy queue"


def app(section: dict[str, Any]) -> Iterator[str]:
    """The application's section."""
    threshold = section.get("min_ready_routes", "all")
    number = int(threshold) if str(threshold).strip().isdigit() else threshold
    if str(threshold).strip().lower() != "all" and not (isinstance(number, int) and not isinstance(number, bool) and number > 0):
        yield "app.min_ready_routes must be all or a positive number"
    if "half_open_counts_as_ready" in section and str(section["half_open_counts_as_ready"]).strip().lower() not in HALF_OPEN:
        yield f"app.half_open_counts_as_ready must be one of {', '.join(HALF_OPEN)}"
    ms: dict[str, int] = {}
    yield from _durations("app", section, ("warmup_timeout", "drain_timeout", "readiness_cache"), ms)
    if ms.get("readiness_cache", 50) < 50:
        yield "app.readiness_cache must be at least 50ms"
    for name, part in (section.get("limits") or {}).items():
        if name == "routes":
            yield from limits("app.limits.routes", part)
        else:
            for key, value in (part or {}).items() if isinstance(part, dict) else ():
                if value is not None and value < 1:
                    yield f"app.limits.{name}.{key} must be greater than 0"
    yield from budget("app.retry_budget", section.get("retry_budget"))
    for flag in section.get("feature_flags") or ():
        if str(flag).strip() and str(flag).strip() not in FEATURES:
            yield f"app.feature_flags: there is no feature {flag}"


def breaker(name: str, section: dict[str, Any] | None) -> Iterator[str]:
    """A connector's circuit breaker: all parts, a rate in (0, 1], bounds in order."""
    if section is None:
        return
    where = f"connector {name}: cb"
    rate = section.get("failure_rate")
    if rate is None:
        yield f"{where}.failure_rate is missing"
    elif not 0 < float(rate) <= 1:
        yield f"{where}.failure_rate must lie in (0, 1]"
    ms: dict[str, int] = {}
    for part in ("window", "open_base", "open_max"):
        if section.get(part) is None:
            yield f"{where}.{part} is missing"
    yield from _durations(where, section, ("window", "open_base", "open_max"), ms)
    if "open_base" in ms and "open_max" in ms and ms["open_max"] < ms["open_base"]:
        yield f"{where}.open_max must not be less than open_base"


def _given(tls: dict[str, Any], key: str) -> bool:
    return isinstance(tls.get(key), str) and bool(tls[key].strip())


def tls(name: str, kind: str, options: dict[str, Any]) -> Iterator[str]:
    """A connector's TLS section against its kind and address."""
    section = options.get("tls") if isinstance(options.get("tls"), dict) else None
    where = f"connector {name}"
    address, scheme = SECURE.get(kind, ("", ""))
    secure = bool(address) and str(options.get(address, "")).startswith(scheme)
    if kind == "kafka":
        brokers = options.get("brokers")
        listed = brokers if isinstance(brokers, list) else str(brokers or "").split(",")
        if section is None and any(str(b).strip().startswith("ssl://") for b in listed):
            yield f"{where}: ssl:// brokers need tls"
        if section is None and options.get("sasl") is not None:
            yield f"{where}: sasl needs tls"
        return
    if section is None:
        if secure:
            yield f"{where}: {scheme} needs tls"
        return
    cert, key = _given(section, "cert"), _given(section, "key")
    if cert != key:
        yield f"{where}: tls.cert and tls.key belong together"
    if key and "-----BEGIN" in section["key"]:
        yield f"{where}: tls.key must be a path, not a key"
    if kind == "http_server" and not (cert and key):
        yield f"{where}: tls.cert and tls.key are needed to listen"
    if address:
        if (cert or key) and not secure:
            yield f"{where}: client certificates need {scheme} as {address}"
        if secure and not _given(section, "ca"):
            yield f"{where}: {scheme} needs tls.ca"
    mode = str(section["mode"]).strip().lower() if section.get("mode") is not None else None
    if kind in ("postgres", "mariadb") and mode == "disable" and (cert or key or _given(section, "ca")):
        yield f"{where}: tls.mode disable excludes credentials"
    if kind == "smtp":
        if mode not in (None, "starttls", "tls", "none"):
            yield f"{where}: tls.mode must be starttls, tls or none"
        if mode == "none" and (cert or key):
            yield f"{where}: tls.mode none excludes client certificates"
        if (cert or key) and not _given(section, "domain"):
            yield f"{where}: client certificates need tls.domain"


def trigger(route: str, kind: str, options: dict[str, Any], kafka: dict[str, Any] | None) -> Iterator[str]:
    """A route's trigger against the kind of its connector."""
    where = f"route {route}: trigger"
    if kind == "http_client":
        yield f"{where}: an http connector must be a server"
    declared = str(options["type"]).lower() if options.get("type") is not None else None
    if kafka is not None and kind != "kafka":
        yield f"{where}: kafka options on a {kind} connector"
    elif kafka is None and (declared == "rabbitmq" or (declared is None and "queue" in options)) and kind != "rabbitmq":
        yield f"{where}: a queue on a {kind} connector"
    elif kafka is None and (declared == "mqtt" or (declared is None and "topic" in options)) and kind not in ("mqtt", "rabbitmq"):
        yield f"{where}: a topic on a {kind} connector"
    pubsub = str(options.get("mode", "")).lower() == "pubsub"
    needed = {
        "kafka": ("topic", "group_id"), "rabbitmq": ("queue",), "mqtt": ("topic",), "mongodb": ("database", "collection"),
        "redis": ("channels",) if pubsub else ("stream",),
    }.get(kind, ())
    have = (kafka or {}) if kind == "kafka" else options
    for name in needed:
        if have.get(name) is None:
            yield f"{where} option {name} is missing"
    if kind in ("http_server", "http_client") and "codec" in options:
        yield f"{where}: an http trigger has no codec"
    for section in (options, *([kafka] if kafka is not None else [])):
        if kind not in POLLING:
            for name in ("retry_initial", "retry_max", "retry_multiplier"):
                if name in section:
                    yield f"{where}: {name} is not supported"
    if kind in POLLING:
        for name in ("retry_initial_ms", "retry_max_ms"):
            if name in options:
                yield f"{where}: {name} is out of use, take {name.removesuffix('_ms')}"
        ms: dict[str, int] = {}
        yield from _durations(where, options, ("retry_initial", "retry_max"), ms)
        if len(ms) == 2 and ms["retry_max"] < ms["retry_initial"]:
            yield f"{where}: retry_max must not be less than retry_initial"
        if options.get("retry_multiplier") is not None:
            try:
                if not 1.1 <= float(options["retry_multiplier"]) <= 10:
                    yield f"{where}: retry_multiplier must lie between 1.1 and 10"
            except ValueError:
                yield f"{where}: retry_multiplier is no number"
        if options.get("retry_limit") is not None and not str(options["retry_limit"]).strip().isdigit():
            yield f"{where}: retry_limit is no whole number"


def gates(flags: Any, connectors: dict[str, Any], routes: dict[str, Any]) -> Iterator[str]:
    """Kinds and phases that a document must switch on by ``app.feature_flags``."""
    on = {str(f).strip() for f in flags or ()}
    for c in connectors.values():
        if c.kind in GATED_KINDS and c.kind not in on:
            yield f"connector {c.name}: the kind {c.kind} needs its feature flag"
    for route in routes.values():
        for phase in route.phases:
            flag = GATED_PHASES.get(phase.kind)
            if flag and flag not in on:
                yield f"route {route.name}, phase {phase.name}: {phase.kind} needs the feature flag {flag}"


def management(section: dict[str, Any] | None) -> Iterator[str]:
    """The management section: a port, known endpoints with a path only."""
    if section is None:
        return
    if section.get("port") is None:
        yield "management.port is missing"
    for name, value in section.items():
        if name in ("host", "port"):
            continue
        if name not in ("live", "ready", "status", "metrics", "health"):
            yield f"management: unknown key {name}"
        elif value is not None and set(value) - {"path"}:
            yield f"management.{name}: only a path is known"
