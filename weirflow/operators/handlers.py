"""Phases that run at once: richer slots than planned ones, and calls that are really made.

A handler takes the phase, the slots and the registry of connectors and gives
the slot and its error as columns. Options are resolved as templates; ``$.x``
there stands for ``.x`` whatever ``x`` is. Calls to other systems go through a
transport, a function of a list of requests that runs on the executors.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weirflow.config.connectors import OptionError, Registry
from weirflow.config.loader import Phase
from weirflow.functions import expressions as ex
from weirflow.functions import scalars
from weirflow.operators.phases import Planned, _object, _Options
from weirflow.operators.records import first_seen

#: A transport answers requests ``{method, url, header, body, content_type}`` with ``{status, header, body}``.
Transport = Callable[[list[dict[str, Any]]], list[dict[str, Any]]]


class HandlerError(ValueError):
    """A phase that cannot run; ``kind`` is MissingOption, InvalidConfiguration or InvalidInput."""

    def __init__(self, kind: str, phase: str, reason: str):
        super().__init__(f"phase {phase}: {reason}")
        self.kind = kind


def canonical(node: Any) -> Any:
    """A template in which whole strings ``$.x`` are written ``.x``."""
    if isinstance(node, dict):
        return {k: canonical(v) for k, v in node.items()}
    if isinstance(node, list):
        return [canonical(v) for v in node]
    if isinstance(node, str) and node.strip().startswith("$."):
        return node.strip()[1:]
    return node


class _Handled(_Options):
    def __init__(self, phase: Phase, slots: ex.Slots, registry: Registry):
        super().__init__(replace(phase, options=canonical(phase.options)), slots)
        self.registry = registry

    def need(self, name: str) -> Any:
        if self.options.get(name) in (None, ""):
            raise HandlerError("MissingOption", self.phase.name, f"option {name} is missing")
        return self.options[name]

    def client(self, kind: str):
        if not self.phase.connector:
            raise HandlerError("MissingOption", self.phase.name, "option connector is missing")
        try:
            return self.registry.get(self.phase.connector, kind)
        except (LookupError, OptionError) as error:
            raise HandlerError("InvalidConfiguration", self.phase.name, str(error)) from error


def transform(phase: Phase, slots: ex.Slots, registry: Registry) -> Planned:
    """All options, resolved."""
    value, error = ex.template(canonical(phase.options), slots)
    return Planned(value, error)


def kafka_producer(phase: Phase, slots: ex.Slots, registry: Registry) -> Planned:
    """What would be sent, with the brokers it would go to; topic and key are resolved."""
    o = _Handled(phase, slots, registry)
    o.need("topic")
    client = o.client("kafka")
    fields = {
        "connector": F.lit(phase.connector), "topic": o.text("topic"), "payload": o.previous("payload"), "key": o.value("key"),
        "brokers": F.array(*map(F.lit, client["brokers"])), "create_topics_if_missing": F.lit(client["create_topics_if_missing"]),
    }
    if o.options.get("header"):
        if not isinstance(o.options["header"], dict):
            raise HandlerError("InvalidInput", phase.name, "header must hold names and values")
        fields["header"] = o.value("header")
    if "acks" in o.options:
        fields["acks"] = o.text("acks")
    return Planned(_nested(fields | {"count": F.lit(1)}), o.error())


def _nested(fields: dict[str, Column]) -> Column:
    """An object of columns of any type; nulls stay as nulls."""
    inner = {n: F.try_variant_get(F.to_variant_object(F.struct(c.alias("v"))), "$.v", "variant") for n, c in fields.items()}
    return _object(**inner)


def mqtt_publish(phase: Phase, slots: ex.Slots, registry: Registry) -> Planned:
    """What would be published and where; there is no status."""
    o = _Handled(phase, slots, registry)
    o.need("topic")
    client = o.client("mqtt")
    asked, payload = o.value("qos"), o.previous("payload")
    qos = scalars.qos(F.when(F.is_variant_null(asked), F.lit(None)).otherwise(ex.stringify(asked)))
    retain = scalars.retain(o.value("retain", default=False))
    encoding = str(o.options.get("payload_encoding", "json")).lower()
    if encoding not in ("json", "base64"):
        raise HandlerError("InvalidInput", phase.name, f"unknown payload_encoding {encoding}")
    encoded = F.base64(scalars.mqtt_bytes(payload)) if encoding == "base64" else F.to_json(payload)
    packet = F.when(qos > 0, scalars.packet_id(slots.sequence)) if slots.sequence is not None else F.lit(None).cast("int")
    slot = _object(
        connector=F.lit(phase.connector), topic=o.text("topic"), payload=payload, payload_encoding=F.lit(encoding),
        payload_encoded=encoded, qos=qos, retain=retain, packet_id=packet,
        published_at=scalars.rfc3339(F.current_timestamp()), url=F.lit(client["url"]),
    )
    wrong = qos.isNull() | retain.isNull() | encoded.isNull()
    return Planned(slot, F.coalesce(o.error(), F.when(wrong, F.lit("InvalidInput"))))


def postgres_insert(phase: Phase, slots: ex.Slots, registry: Registry) -> Planned:
    """The statement and its parameters; ``values`` must hold names and values."""
    o = _Handled(phase, slots, registry)
    o.need("sql")
    client = o.client("postgres")
    if not isinstance(o.options.get("values", {}), dict):
        raise HandlerError("InvalidInput", phase.name, "values must hold names and values")
    slot = _object(
        connector=F.lit(phase.connector), sql=o.text("sql"), parameters=o.value("values", default={}),
        url=F.lit(client["url"]), schema=F.lit(client["schema"]), count=F.lit(1),
    )
    return Planned(slot, o.error())


def mariadb_insert(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``inserted`` and ``count`` of each row: true and 1 for a key's first one."""
    return first_seen(rows, keys, order)


def http_request(phase: Phase, slots: ex.Slots, registry: Registry) -> Planned:
    """The request of an http client phase, with the connector's default headers below its own."""
    o = _Handled(phase, slots, registry)
    client = o.client("http_client")
    defaults = dict(client["default_headers"] or {})
    own = o.options.get("header") or {}
    if not isinstance(own, dict):
        raise HandlerError("InvalidInput", phase.name, "header must hold names and values")
    o.options = o.options | {"header": defaults | own}
    url = scalars.resolve_url(F.lit(client["base_url"]), o.text("path", default="/"))
    request = _object(
        method=F.upper(o.text("method", default="GET")), url=url, header=o.value("header", default={}), body=o.value("body"),
        content_type=ex.stringify(o.value("contentType")),
    )
    return Planned(request, F.coalesce(o.error(), F.when(url.isNull(), F.lit("InvalidConfiguration"))))


def http_call(rows: DataFrame, request: str, transport: Transport, out: str = "response") -> DataFrame:
    """``rows`` with ``out``: ``{status, durationMs, header?, body}`` of the variant column ``request``.

    ``error`` is ``Transport`` where the call failed or gave a status of 400 or
    more, and there is no response then; rows without a request are not called.
    """
    kept = [c for c in rows.columns if c != request]
    text = [StructField(name, StringType()) for name in ("__json", "error")]
    schema = StructType([*rows.select(*kept).schema.fields, *text])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            answers, errors = [], []
            for text in frame["__request"]:
                if text is None:
                    answers.append(None)
                    errors.append(None)
                    continue
                began = time.monotonic()
                try:
                    answer = transport([json.loads(text)])[0]
                    failed = int(answer["status"]) >= 400
                except Exception:  # noqa: BLE001 - whatever a transport raises is the row's error
                    failed, answer = True, {}
                took = int((time.monotonic() - began) * 1000)
                slot = {"status": answer.get("status"), "durationMs": took}
                slot |= {"header": answer["header"]} if answer.get("header") else {}
                answers.append(None if failed else json.dumps(slot | {"body": answer.get("body")}))
                errors.append("Transport" if failed else None)
            yield frame[kept].assign(__json=answers, error=errors)

    called = rows.select(*kept, F.to_json(request).alias("__request")).mapInPandas(run, schema)
    return called.withColumn(out, F.parse_json("__json")).drop("__json")


HANDLERS = {
    "transform": transform, "kafka_producer": kafka_producer, "mqtt": mqtt_publish,
    "postgres_idempotent_insert": postgres_insert, "http_client": http_request,
}


def register(kind: str, handler: Callable[[Phase, ex.Slots, Registry], Planned]) -> None:
    """Add a handler of one's own."""
    HANDLERS[kind] = handler


def handle(phase: Phase, slots: ex.Slots, registry: Registry) -> Planned:
    """The slot of a phase by its handler."""
    if phase.kind not in HANDLERS:
        raise HandlerError("InvalidConfiguration", phase.name, f"there is no handler for {phase.kind}")
    return HANDLERS[phase.kind](phase, slots, registry)
