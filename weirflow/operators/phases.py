"""Phases: the slot each one writes and the actions it emits.

Outbound phases only plan: the slot holds what is known before delivery, and the
action row what a sink needs. A later phase never sees a real response.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow.codecs import envelope
from weirflow.config.loader import Phase
from weirflow.config.options import expand
from weirflow.config.rules import duration_ms
from weirflow.functions import expressions as ex
from weirflow.functions import scalars


@dataclass
class Action:
    kind: str
    connector: str | None
    target: Column
    payload: Column
    phase: str | None = None
    #: Further arguments of the effect as JSON text.
    extra: Column | None = None
    #: Null where the action is not emitted (None: always).
    when: Column | None = None


@dataclass
class Planned:
    slot: Column
    error: Column
    actions: list[Action] = field(default_factory=list)


class _Options:
    """Options resolved against the slots; collects the first error."""

    def __init__(self, phase: Phase, slots: ex.Slots, with_previous: bool = True):
        self.phase, self.slots, self.options = phase, slots, phase.options
        self.errors: list[Column] = []
        self.with_previous = with_previous

    def value(self, *names: str, default: Any = None) -> Column:
        for name in names:
            if name in self.options:
                value, error = ex.template(self.options[name], self.slots)
                self.errors.append(error)
                return value
        return default if isinstance(default, Column) else ex.variant_literal(default)

    def previous(self, *names: str) -> Column:
        """The option, by default the previous slot (null for a later fallback phase)."""
        last = self.slots.columns[-1] if self.with_previous else ex.variant_literal(None)
        return self.value(*names, default=last)

    def text(self, *names: str, default: str | None = None) -> Column:
        return ex.stringify(self.value(*names, default=default))

    def error(self) -> Column:
        return F.coalesce(*self.errors, F.lit(None).cast("string"))

    def extra(self, *names: str, **fields: Column) -> Column:
        """The named options, the timeout and ``fields`` as JSON text."""
        found = {n: self.value(n) for n in names if n in self.options} | fields
        if self.phase.timeout_ms is not None:
            found["timeout_ms"] = F.lit(self.phase.timeout_ms)
        return F.to_json(_object(**found)) if found else F.lit("{}")

    def timeout(self) -> dict[str, Column]:
        """The slot's field for the timeout, if there is one."""
        return {"timeout_ms": F.lit(self.phase.timeout_ms)} if self.phase.timeout_ms is not None else {}


def _object(**fields: Column) -> Column:
    parts = (F.coalesce(v.cast("variant"), ex.variant_literal(None)).alias(k) for k, v in fields.items())
    return F.to_variant_object(F.struct(*parts))


def _pending(**fields: Column) -> Column:
    return _object(**fields, status=F.lit("pending"), count=F.lit(1))


def _transform(o: _Options) -> Planned:
    slot, error = ex.template(o.options, o.slots)
    return Planned(slot, error)


def _serialize(o: _Options) -> Planned:
    source = o.previous("input")
    encoded = envelope.encode(F.to_json(source), o.options["codec"], o.options)
    slot = F.to_variant_object(encoded)
    error = F.coalesce(o.error(), F.when(encoded["binary"].isNull(), F.lit("Serialization")))
    return Planned(slot, error)


def _kafka(o: _Options) -> Planned:
    payload = o.previous("payload")
    key = ex.stringify(o.value("key")) if "key" in o.options else F.lit(None).cast("string")
    value = _object(key=key, value=scalars.payload_text(payload))
    slot = ex.variant_literal({"count": 1})
    others = [n for n in o.options if n not in ("topic", "payload", "key")]
    action = Action("kafka", o.phase.connector, F.lit(str(o.options["topic"])), F.to_json(value), extra=o.extra(*others))
    return Planned(slot, o.error(), [action])


def _http(o: _Options) -> Planned:
    method = F.upper(o.text("method", default="GET"))
    path = o.text("path", default="/")
    headers = o.value("header", "headers", default={})
    body = o.value("body")
    kind = o.text("contentType", "content_type", default="application/json")
    request = _object(method=method, header=headers, body=body, content_type=kind)
    target = F.concat(method, F.lit(" "), scalars.normalise_path(path))
    action = Action("http", o.phase.connector, target, F.to_json(request), extra=o.extra())
    return Planned(ex.variant_literal(None), o.error(), [action])


def _grpc(o: _Options) -> Planned:
    rpc = o.options.get("rpc") or f"{o.options.get('service', '')}/{o.options.get('method', '')}"
    parts = [p.strip() for p in str(rpc).split("/")]
    if len(parts) != 2 or not all(parts):
        raise ValueError(f"phase {o.phase.name}: {rpc!r} is no service/method")
    request = _object(request=o.previous("request"), metadata=o.value("metadata", default={}))
    action = Action("grpc", o.phase.connector, F.lit("/".join(parts)), F.to_json(request), extra=o.extra("descriptor"))
    return Planned(ex.variant_literal(None), o.error(), [action])


def _rabbitmq(o: _Options) -> Planned:
    exchange, key = o.text("exchange", default=""), o.text("routing_key", default="")
    body = o.previous("body")
    slot = _pending(
        connector=F.lit(o.phase.connector), exchange=exchange, routing_key=key, body=body,
        headers=o.value("headers", default={}), properties=o.value("properties", default={}),
        mandatory=F.lit(bool(o.options.get("mandatory", False))), confirm=F.lit(bool(o.options.get("confirm", True))),
    )
    target = F.concat_ws("/", exchange, key)
    return Planned(slot, o.error(), [Action("rabbitmq", o.phase.connector, target, scalars.payload_text(body))])


def _mqtt(o: _Options) -> Planned:
    """``packet_seq`` numbers the plan's messages where the events have it; else packet ids are unknown before delivery."""
    topic, payload = o.text("topic"), o.previous("payload")
    asked = o.value("qos")
    qos = scalars.qos(F.when(F.is_variant_null(asked), F.lit(None)).otherwise(ex.stringify(asked)))
    retain = scalars.retain(o.value("retain", default=False))
    encoding = o.options.get("payload_encoding", "json")
    raw = scalars.mqtt_bytes(payload) if encoding == "base64" else F.to_json(payload).cast("binary")
    encoded = F.base64(raw) if encoding == "base64" else F.to_json(payload)
    packet = F.when(qos > 0, scalars.packet_id(o.slots.sequence)) if o.slots.sequence is not None else F.lit(None).cast("int")
    slot = _object(
        connector=F.lit(o.phase.connector), topic=topic, payload=payload, payload_encoding=F.lit(encoding),
        payload_encoded=encoded, qos=qos, retain=retain, packet_id=packet,
        published_at=scalars.rfc3339(F.current_timestamp()), **o.timeout(), status=F.lit("pending"),
    )
    error = F.coalesce(o.error(), F.when(qos.isNull() | retain.isNull() | raw.isNull(), F.lit("InvalidPhaseOptions")))
    extra = o.extra(qos=qos, retain=retain, packet_id=packet, payload_encoding=F.lit(encoding))
    return Planned(slot, error, [Action("mqtt", o.phase.connector, topic, encoded, extra=extra)])


def _people(o: _Options, name: str) -> Column:
    value = o.options.get(name)
    if isinstance(value, list):
        parts = [scalars.recipients(ex.stringify(_tracked(o, v))) for v in value]
        return F.array_distinct(F.concat(*parts))
    if value is None:
        return F.expr("cast(array() as array<string>)")
    return F.array_distinct(scalars.recipients(o.text(name)))


def _tracked(o: _Options, node: Any) -> Column:
    value, error = ex.template(node, o.slots)
    o.errors.append(error)
    return value


def _smtp(o: _Options) -> Planned:
    groups = {name: _people(o, name) for name in ("to", "cc", "bcc")}
    everyone = F.array_distinct(F.concat(*groups.values()))
    subject, body = o.text("subject", default=""), o.text("body", default="")
    reply = o.text("reply_to") if "reply_to" in o.options else F.lit(None).cast("string")
    headers, attachments = o.value("headers", default={}), o.value("attachments", default=[])
    attached = F.coalesce(F.size(F.try_variant_get(attachments, "$", "array<variant>")), F.lit(0))
    slot = F.to_variant_object(
        F.struct(
            F.lit(o.phase.connector).alias("connector"), o.text("from", default="").alias("from"),
            *(g.alias(n) for n, g in groups.items()), reply.alias("reply_to"), subject.alias("subject"),
            F.size(everyone).alias("recipients"), attached.alias("attachments"),
            F.lit("pending").alias("status"), F.lit(1).alias("count"),
        )
    )
    error = F.coalesce(o.error(), F.when(F.size(everyone) == 0, F.lit("InvalidPhaseOptions")))
    payload = F.to_json(F.struct(subject.alias("subject"), body.alias("body")))
    extra = o.extra(reply_to=reply, headers=headers, attachments=attachments)
    return Planned(slot, error, [Action("smtp", o.phase.connector, F.array_join(everyone, ","), payload, extra=extra)])


def _mariadb(o: _Options) -> Planned:
    key, value = o.text("key"), o.previous("value")
    slot = _pending(connector=F.lit(o.phase.connector), key=key, values=value)
    return Planned(slot, o.error(), [Action("mariadb", o.phase.connector, key, F.to_json(value))])


def _postgres(o: _Options) -> Planned:
    sql, values = o.text("sql"), o.previous("values")
    slot = _pending(connector=F.lit(o.phase.connector), sql=sql, parameters=values)
    return Planned(slot, o.error(), [Action("postgres", o.phase.connector, sql, F.to_json(values))])


# Counters that a document operation's slot has, null before delivery.
_COUNTERS = ("inserted_id", "matched_count", "modified_count", "deleted_count", "results")


def _mongodb(o: _Options) -> Planned:
    operation = o.options["operation"]
    parts = {n: o.value(n) for n in ("document", "filter", "update", "pipeline") if n in o.options}
    counters = {n: ex.variant_literal(None) for n in _COUNTERS}
    slot = _object(
        connector=F.lit(o.phase.connector), collection=o.text("collection"), operation=F.lit(operation), **o.timeout(),
        status=F.lit("pending"), **counters, **parts,
    )
    payload = F.to_json(_object(operation=F.lit(operation), **parts))
    return Planned(slot, o.error(), [Action("mongodb", o.phase.connector, o.text("collection"), payload, extra=o.extra())])


def _redis(o: _Options) -> Planned:
    command = str(o.options["command"]).lower()
    arguments = {k: o.value(k) for k in o.options if k != "command"}
    known = _object(**arguments) if arguments else ex.variant_literal({})
    slot = _pending(connector=F.lit(o.phase.connector), command=F.lit(command), arguments=known)
    return Planned(slot, o.error(), [Action("redis", o.phase.connector, F.lit(command), F.to_json(known))])


def _parallel(o: _Options) -> Planned:
    """Children see the same slots; a child that fails without being optional fails the phase, an optional one is skipped.

    A child that fails emits no action.
    """
    children, actions, errors, partial = {}, [], [], F.lit(False)
    for i, raw in enumerate(o.options["phases"]):
        options = dict(expand(raw.get("options") or {}))
        asked = raw.get("timeout_ms", raw.get("timeout"))
        timeout = duration_ms(asked) if asked is not None else None
        child = Phase(str(raw.get("name", i)), str(raw.get("type")), options, options.pop("connector", raw.get("connector")), timeout)
        planned = plan_phase(child, o.slots)
        optional = bool(raw.get("optional", False))
        failed = planned.error.isNotNull()
        if optional:
            partial = partial | failed
        else:
            errors.append(planned.error)
        children[child.name] = _object(
            status=F.when(failed, "skipped" if optional else "failed").otherwise("pending"),
            output=F.when(~failed, planned.slot), optional=F.lit(optional), fallback=F.lit(raw.get("fallback")),
            timeout_ms=F.lit(timeout), error=planned.error,
        )
        for action in planned.actions:
            action.phase = child.name
            action.when = ~failed if optional else None
        actions += planned.actions
    mode = o.options.get("aggregation", "all")
    quorum = int(o.options.get("quorum") or math.ceil(len(children) / 2))
    fields = {"aggregation": F.lit(mode)} | ({"quorum": F.lit(quorum)} if mode == "quorum" else {}) | o.timeout()
    slot = _object(
        **fields, aggregation_state=F.when(partial, "partial").otherwise("pending"), children=_object(**children)
    )
    return Planned(slot, F.coalesce(*errors, F.lit(None).cast("string")), actions)


PHASES = {
    "transform": _transform, "serialize": _serialize, "parallel": _parallel, "kafka_producer": _kafka,
    "http_client": _http, "grpc_client": _grpc, "rabbitmq": _rabbitmq, "mqtt": _mqtt, "smtp_send": _smtp,
    "mariadb_idempotent_insert": _mariadb, "postgres_idempotent_insert": _postgres, "mongodb": _mongodb,
    "redis": _redis,
}


def register(kind: str, handler) -> None:
    """Add a phase of one's own: ``handler(options) -> Planned``."""
    PHASES[kind] = handler


def plan_phase(phase: Phase, slots: ex.Slots, with_previous: bool = True) -> Planned:
    handler = PHASES.get(phase.kind)
    if handler is None:  # plans, but fails on every event
        return Planned(ex.variant_literal(None), F.lit("UnsupportedPhase"))
    return handler(_Options(phase, slots, with_previous))
