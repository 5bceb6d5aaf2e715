"""Trigger envelopes: transport rows to the VARIANT slot 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.functions import scalars

TRANSPORTS = ("http", "kafka", "rabbitmq", "mqtt", "mongodb", "redis_pubsub", "redis_stream")


def _null() -> Column:
    return F.parse_json(F.lit("null"))


def _json_or_null(text: Column) -> Column:
    return F.coalesce(F.try_parse_json(text), _null())


def _unwrap(values: Column) -> Column:
    """A header's value: text if it came once, else the list of its values."""
    one = F.when(F.size(values) == 1, values[0].cast("variant"))
    return F.coalesce(one, F.to_variant_object(values))


def bytes_object(c: Column) -> Column:
    """Variant ``{base64, text?, json?}`` of bytes: text only if UTF-8, json only if it parses."""
    base, text = F.base64(c).alias("base64"), c.cast("string").alias("text")
    parsed = F.try_parse_json(c.cast("string"))
    as_text = F.to_variant_object(F.struct(base, text))
    as_json = F.to_variant_object(F.struct(base, text, parsed.alias("json")))
    valid = F.is_valid_utf8(c.cast("string"))
    return F.when(c.isNotNull(), F.when(valid & parsed.isNotNull(), as_json).when(valid, as_text).otherwise(F.to_variant_object(F.struct(base))))


def present(optional: tuple[str, ...] = (), **fields: Column) -> Column:
    """Variant object of ``fields``; those named ``optional`` are left out where they are null."""
    if not optional:
        return F.to_variant_object(F.struct(*(v.alias(k) for k, v in fields.items())))
    name, *others = optional
    without = {k: v for k, v in fields.items() if k != name}
    return F.when(fields[name].isNotNull(), present(tuple(others), **fields)).otherwise(present(tuple(others), **without))


def is_json(content_type: Column) -> Column:
    """Whether a content type tells of JSON; an absent one does."""
    return F.coalesce(F.lower(content_type).contains("json"), F.lit(True))


def http(
    method: Column, path: Column, headers: Column, query: Column, body: Column, received: Column, content_type: Column | None = None
) -> Column:
    """Envelope of a request; ``headers`` is an array of (key, value), ``query`` a query string, ``body`` text or bytes.

    A JSON body is parsed, one of another ``content_type`` becomes
    ``{base64, text?, json?}``, an empty one null. See :func:`http_error`.
    """
    named = F.transform(headers, lambda h: F.struct(scalars.header_name(h["key"]).alias("key"), h["value"].alias("value")))
    merged = F.transform_values(scalars.merged_values(named), lambda _, v: _unwrap(v))
    params = F.transform_values(scalars.merged_values(scalars.query_pairs(query)), lambda _, v: _unwrap(v))
    raw = body.cast("binary")
    as_json = is_json(F.lit(None).cast("string") if content_type is None else content_type)
    content = (
        F.when(raw.isNull() | (F.octet_length(raw) == 0), _null())
        .when(as_json, _json_or_null(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))))
        .otherwise(bytes_object(raw))
    )
    asked = F.when(query != "", query)
    clean = scalars.normalise_path(path)
    return F.to_variant_object(
        F.struct(
            merged.alias("headers"), merged.alias("header"), params.alias("query"),
            present(("query",), method=method, path=clean, query=asked).alias("request"),
            F.struct(clean.alias("value")).alias("path"), content.alias("body"),
            present(("query",), method=method, path=clean, query=asked, received_at=received).alias("metadata"),
        )
    )


def http_error(
    method: Column, path: Column, body: Column, content_type: Column, route_method: str, route_path: str, most_bytes: int = 1_048_576
) -> Column:
    """Why a request is not taken by a route: its path, its method, its size or a body that is no JSON; else null."""
    raw = F.coalesce(body.cast("binary"), F.lit(b""))
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    broken = is_json(content_type) & (F.octet_length(raw) > 0) & F.try_parse_json(text).isNull()
    return (
        F.when(scalars.normalise_path(path) != route_path, "ROUTE_UNKNOWN")
        .when(F.upper(method) != route_method.upper(), "METHOD_MISMATCH")
        .when(F.octet_length(raw) > most_bytes, "PAYLOAD_TOO_LARGE")
        .when(broken, "MISSING_KEY")
    )


def kafka(topic: Column, partition: Column, offset: Column, timestamp: Column, key: Column, value: Column, headers: Column) -> Column:
    """Envelope of a record; the body is ``.body`` of a JSON value, else the value, else its text."""
    view = scalars.bytes_view(value)
    parsed = view["json"]
    body = F.coalesce(F.try_variant_get(parsed, "$.body", "variant"), parsed, view["text"].cast("variant"), _null())
    named = F.transform(headers, lambda h: F.struct(scalars.header_name(h["key"]).alias("key"), h["value"].cast("string").alias("value")))
    merged = F.transform_values(scalars.merged_values(named, distinct=True), lambda _, v: _unwrap(v))
    return present(
        ("timestamp", "key"), topic=topic, partition=partition, offset=offset, timestamp=timestamp, key=bytes_object(key), value=bytes_object(value),
        payload=bytes_object(value), body=body, headers=merged, header=merged,
    )


def phase_record(value: Column) -> Column:
    """``struct(phase_id, payload, error)`` of a record that names its phase; ``error`` unless it is such an object."""
    parsed = scalars.bytes_view(value)["json"]
    phase = F.try_variant_get(parsed, "$.phase_id", "string")
    payload = F.try_variant_get(parsed, "$.payload", "variant")
    good = phase.isNotNull() & payload.isNotNull()
    return F.struct(phase.alias("phase_id"), payload.alias("payload"), F.when(~good, F.lit("InvalidInput")).alias("error"))


def rabbitmq(
    body: Column, exchange: Column, routing_key: Column, tag: Column, redelivered: Column, timestamp: Column,
    headers: Column | None = None, properties: Column | None = None,
) -> Column:
    """Envelope of a delivery; ``headers`` and ``properties`` are variants or maps."""
    empty = F.parse_json(F.lit("{}"))
    return present(
        ("metadata",), body=bytes_object(body), exchange=exchange, routing_key=routing_key, delivery_tag=tag, redelivered=redelivered,
        headers=empty if headers is None else headers,
        properties=empty if properties is None else properties,
        metadata=F.when(timestamp.isNotNull(), F.to_variant_object(F.struct(timestamp.alias("timestamp")))),
    )


def mqtt(topic: Column, payload: Column, qos: Column, retain: Column, packet: Column, timestamp: Column | None = None) -> Column:
    """Envelope of a message; there is metadata only with a packet id or a timestamp."""
    known = {"packet_id": packet} | ({} if timestamp is None else {"timestamp": timestamp})
    some = F.coalesce(*(c.cast("long") for c in known.values())).isNotNull()
    metadata = F.when(some, present(tuple(known), **known))
    return present(("metadata",), topic=topic, qos=qos, retain=retain, payload=bytes_object(payload), metadata=metadata)


def mongodb(
    operation: Column, database: Column, collection: Column, key: Column, document: Column, wall_time: Column,
    before: Column | None = None, update: Column | None = None, cluster_time: Column | None = None, token: Column | None = None,
) -> Column:
    """Envelope of a change; documents are JSON text, ``cluster_time`` is ``struct(seconds, increment)``."""
    documents = {"fullDocumentBeforeChange": before, "updateDescription": update}
    optional = {k: F.try_parse_json(v) for k, v in documents.items() if v is not None}
    stamps = {"clusterTime": cluster_time, "resumeToken": None if token is None else F.try_parse_json(token)}
    stamps = {k: v for k, v in stamps.items() if v is not None}
    return present(
        tuple(optional), operationType=operation, ns=F.struct(database.alias("db"), collection.alias("coll")),
        documentKey=F.struct(key.alias("_id")), fullDocument=_json_or_null(document), **optional,
        metadata=present(tuple(stamps), wallTime=scalars.rfc3339(wall_time), **stamps),
    )


def redis_pubsub(channel: Column, payload: Column, arrived_ms: Column) -> Column:
    """Envelope of a channel's message; it has no attributes."""
    return present(
        channel=channel, payload=bytes_object(payload), attributes=F.parse_json(F.lit("{}")), metadata=F.struct(arrived_ms.alias("timestamp"))
    )


def redis_stream(stream: Column, entry: Column, fields: Column, arrived_ms: Column) -> Column:
    """Envelope of a stream entry; an integer field ``timestamp`` overrides the arrival."""
    stamp = F.coalesce(fields["timestamp"].cast("string").try_cast("bigint"), arrived_ms)
    rest = F.map_filter(fields, lambda k, _: ~k.isin("payload", "timestamp"))
    attributes = F.transform_values(rest, lambda _, v: v.cast("string"))
    return present(
        stream=stream, id=entry, payload=bytes_object(fields["payload"]), attributes=attributes, metadata=F.struct(stamp.alias("timestamp"))
    )


def without_retained(messages: DataFrame, handling: int | str = 0) -> DataFrame:
    """Messages an MQTT trigger sees: retained ones are ignored under handling 1, 2 or ``ignore``."""
    return messages if handling in (0, "0", "include") else messages.where(~F.col("retain"))
