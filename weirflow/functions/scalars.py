"""Scalar functions of routes, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def header_name(c) -> Column:
    """Lower-case header name with ``_`` for ``-``."""
    return F.replace(F.lower(_col(c)), F.lit("-"), F.lit("_"))


def normalise_path(c) -> Column:
    """Trimmed path with a leading slash; empty or null becomes ``/``."""
    p = F.trim(F.coalesce(_col(c), F.lit("")))
    return F.when(p == "", "/").when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def recipients(c) -> Column:
    """Addresses between commas and semicolons, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(_col(c), "[,;]"), lambda x: F.trim(x)), lambda x: x != "")


def quote_identifier(c) -> Column:
    """Back-quoted dotted identifier; null if a part is empty or holds other characters."""
    name = _col(c)
    quoted = F.concat(F.lit("`"), F.replace(name, F.lit("."), F.lit("`.`")), F.lit("`"))
    return F.when(name.rlike(r"^[A-Za-z0-9_$]+(\.[A-Za-z0-9_$]+)*$"), quoted)


def endpoint_id(c) -> Column:
    """``endpoint.<name>`` of at most 36 characters; cut names end with four hash digits.

    The suffix hashes the whole name with MD5, so it is the same on every system.
    """
    full = F.concat(F.lit("endpoint."), _col(c))
    short = F.concat(F.substring(full, 1, 31), F.lit("-"), F.substring(F.md5(full), 1, 4))
    return F.when(F.length(full) <= 36, full).otherwise(short)


def bound_label(c) -> Column:
    """A metric label of at most 40 characters, if it has more than 40 bytes."""
    return F.when(F.octet_length(_col(c)) > 40, F.substring(_col(c), 1, 40)).otherwise(_col(c))


# Unit names of durations and their seconds.
_UNITS = (
    ("nanos|nsec|ns", 1e-9), ("micros|usec|us", 1e-6), ("millis|msec|ms", 1e-3), ("seconds|second|secs|sec|s", 1),
    ("minutes|minute|mins|min|m", 60), ("hours|hour|hrs|hr|h", 3600), ("days|day|d", 86_400),
    ("weeks|week|wks|wk|w", 604_800), ("months|month|M", 2_630_016), ("years|year|yrs|yr|y", 31_557_600),
)
_SPAN = r"([0-9]+)\s*(" + "|".join(names for names, _ in _UNITS) + r")(?![A-Za-z])"


def duration_ms(text: str) -> float | None:
    """Milliseconds of a text such as ``1m 30s`` or ``2weeks``; None if it is no duration."""
    if not re.fullmatch(rf"\s*({_SPAN}\s*)+", text, re.A):
        return None
    seconds = {name: factor for names, factor in _UNITS for name in names.split("|")}
    return sum(int(m[1]) * seconds[m[2]] * 1000 for m in re.finditer(_SPAN, text, re.A))


def timeout_ms(c) -> Column:
    """Milliseconds of an integer or of a text such as ``1m 30s`` or ``2weeks``; null if it is neither."""
    text = F.trim(_col(c))
    parts = F.regexp_extract_all(text, F.lit(_SPAN), 0)

    def worth(part: Column) -> Column:
        number, unit = F.regexp_extract(part, "^([0-9]+)", 1).try_cast("bigint"), F.regexp_extract(part, "([A-Za-z]+)$", 1)
        out = F.lit(None).cast("bigint")
        for names, factor in _UNITS:
            value = number * int(factor * 1000) if factor >= 1e-3 else F.floor(number * (factor * 1000))
            out = F.when(unit.isin(*names.split("|")), value).otherwise(out)
        return out

    total = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, part: n + worth(part))
    good = text.rlike(rf"^({_SPAN}\s*)+$")
    return F.coalesce(F.when(text.rlike("^[0-9]+$"), text.try_cast("bigint")), F.when(good, total))

def is_timeout(c) -> Column:
    """Whether an error message tells of a timeout."""
    return F.coalesce(F.lower(_col(c)).rlike("timed out|timeout"), F.lit(False))


# Error kinds whose class does not depend on the message.
_PROTOCOL = (
    "http_status", "grpc_status", "database", "kafka", "rabbitmq", "mqtt", "redis", "mongodb", "row_not_found",
    "column_not_found", "column_decode", "type_not_found", "pool_closed",
)
_TIMEOUT = ("http_timeout", "grpc_deadline", "io_timeout", "pool_timeout")
_PANIC = ("join", "worker_crashed")


def failure_reason(kind, message) -> Column:
    """Class of an error: timeout, protocol, panic or unknown.

    Its kind decides; a plain message or a transport's message tells of a timeout
    or of nothing known.
    """
    k = F.coalesce(_col(kind), F.lit("message"))
    worded = k.isin("message", "grpc_transport") & is_timeout(message)
    return (
        F.when(k.isin(*_TIMEOUT) | worded, "timeout")
        .when(k.isin(*_PROTOCOL), "protocol")
        .when(k.isin(*_PANIC), "panic")
        .otherwise("unknown")
    )

def rpc_parts(c) -> Column:
    """``struct(service, method)`` of ``service/method``; null unless both are there."""
    parts = F.split(_col(c), "/")
    good = (F.size(parts) == 2) & (F.trim(parts[0]) != "") & (F.trim(F.get(parts, 1)) != "")
    return F.when(good, F.struct(F.trim(parts[0]).alias("service"), F.trim(F.get(parts, 1)).alias("method")))


def log_value(c) -> Column:
    """A log field's value: quoted and escaped if it holds blanks, quotes or ``=``."""
    text = _col(c)
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(text.rlike(r'[\s"=\\]') | (text == ""), F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(text)


def file_name(c) -> Column:
    """A name with ``_`` for all but letters, digits, dots, ``_`` and ``-``."""
    return F.regexp_replace(_col(c), "[^A-Za-z0-9._-]", "_")


def resolve_url(base, path) -> Column:
    """A reference joined to a base URL: as RFC 3986 has it, absolute ones stay, an empty one gives the base.

    Null if the base has no scheme and authority.
    """
    root, ref = _col(base), _col(path)
    shape = r"^([A-Za-z][A-Za-z0-9+.-]*:)(//[^/?#]*)([^?#]*)(\?[^#]*)?"
    scheme, host, own, query = (F.regexp_extract(root, shape, i) for i in range(1, 5))
    tail = F.regexp_extract(ref, r"([?#].*)$", 1)
    bare = F.regexp_extract(ref, r"^([^?#]*)", 1)
    folder = F.when(own == "", "/").otherwise(F.regexp_replace(own, "[^/]*$", ""))
    merged = F.when(bare.startswith("/"), bare).otherwise(F.concat(folder, bare))

    def climb(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.regexp_replace(merged, "^/", ""), "/")
    clean = F.aggregate(parts, F.expr("cast(array() as array<string>)"), climb)
    last = F.element_at(parts, -1)
    end = F.when(last.isin(".", "..") & (F.size(clean) > 0), "/").otherwise("")
    walked = F.concat(F.lit("/"), F.array_join(clean, "/"), end)
    own_path = F.when(own == "", "/").otherwise(own)
    joined = (
        F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref == "", F.concat(scheme, host, own_path, query))
        .when(bare == "", F.concat(scheme, host, own_path, F.when(tail.startswith("?"), tail).otherwise(F.concat(query, tail))))
        .otherwise(F.concat(scheme, host, walked, tail))
    )
    return F.when(root.rlike(shape) | ref.rlike("^https?://"), joined)

def query_pairs(c) -> Column:
    """Decoded ``array<struct<key,value>>`` of a query string in order."""
    parts = F.filter(F.split(F.coalesce(_col(c), F.lit("")), "&"), lambda x: x != "")

    def decode(x: Column) -> Column:
        return F.coalesce(F.try_url_decode(x), x)

    return F.transform(
        parts,
        lambda x: F.struct(
            decode(F.substring_index(x, "=", 1)).alias("key"),
            decode(F.when(F.instr(x, "=") > 0, F.regexp_replace(x, "^[^=]*=", "")).otherwise(F.lit(""))).alias("value"),
        ),
    )


def merged_values(pairs, distinct: bool = False) -> Column:
    """``map<key, array<value>>`` of pairs in order; ``distinct`` keeps a value once."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))

    def values(k: Column) -> Column:
        own = F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"])
        return F.array_distinct(own) if distinct else own

    return F.map_from_arrays(keys, F.transform(keys, values))


def single_or_list(values: Column) -> Column:
    """JSON text of a name's values: the value itself if there is one, else all of them."""
    return F.when(F.size(values) == 1, F.to_json(F.slice(values, 1, 1)).substr(F.lit(2), F.length(F.to_json(F.slice(values, 1, 1))) - 2)).otherwise(F.to_json(values))


def decode_body(c) -> Column:
    """Variant of response bytes: null if empty, JSON if they parse, else text, else base64."""
    raw = _col(c).cast("binary")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return (
        F.when(F.octet_length(raw) == 0, F.parse_json(F.lit("null")))
        .when(F.try_parse_json(text).isNotNull(), F.try_parse_json(text))
        .when(text.isNotNull(), text.cast("variant"))
        .otherwise(F.base64(raw).cast("variant"))
    )


def strict_base64(text: Column) -> Column:
    """Bytes of canonical, padded base64; null for other texts."""
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.when(text.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.base64(raw) == text), raw)


def mqtt_bytes(c) -> Column:
    """Bytes of an MQTT payload variant: none for null, decoded base64 or the text, integers 0 to 255, else JSON.

    Null (an error) for an array that holds anything else.
    """
    v = _col(c)
    shape = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    text = F.when(shape == "STRING", v.cast("string"))
    items = F.try_variant_get(v, "$", "array<variant>")
    whole = F.transform(items, lambda x: F.when(F.schema_of_variant(x) == "BIGINT", F.try_variant_get(x, "$", "bigint")))
    good = F.forall(whole, lambda n: F.coalesce(n.between(0, 255), F.lit(False)))
    digits = F.array_join(F.transform(whole, lambda n: F.lpad(F.hex(n), 2, "0")), "")
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(b""))
        .when(shape == "STRING", F.coalesce(strict_base64(text), text.cast("binary")))
        .when(shape.startswith("ARRAY"), F.when(good, F.unhex(digits)))
        .otherwise(F.to_json(v).cast("binary"))
    )

def bytes_view(c) -> Column:
    """``struct(base64, text, json)`` of bytes: text if UTF-8, json if it parses."""
    raw = _col(c).cast("binary")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    return F.struct(F.base64(raw).alias("base64"), text.alias("text"), F.try_parse_json(text).alias("json"))


def qos(c) -> Column:
    """Quality of service 0 to 2 from a number or text; null counts as 0, others give null."""
    value = F.coalesce(_col(c).cast("string"), F.lit("0")).try_cast("int")
    return F.when(value.between(0, 2), value)


def retain(c) -> Column:
    """Retain flag of a variant: booleans, whole numbers other than 0, true/1/yes/on and false/0/no/off in any case.

    A null counts as false, a number with a fraction too; other texts and values
    are errors and give null.
    """
    v = _col(c)
    shape = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    text = F.when(shape == "STRING", F.lower(v.cast("string")))
    number = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(False))
        .when(shape == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(number, F.when(shape == "BIGINT", F.try_variant_get(v, "$", "bigint") != 0).otherwise(F.lit(False)))
        .when(text.isin("true", "1", "yes", "on"), F.lit(True))
        .when(text.isin("false", "0", "no", "off"), F.lit(False))
    )

def packet_id(sequence) -> Column:
    """Packet ids 1 to 65535 of a sequence that begins at 1."""
    return (F.pmod(_col(sequence) - 1, F.lit(65535)) + 1).cast("int")


def delivery_backoff(attempt, base, most, doublings: int = 16) -> Column:
    """Wait before the next attempt: doubles up to ``doublings`` times (8 for a warm-up), then capped."""
    factor = F.pow(F.lit(2.0), F.least(_col(attempt) - 1, F.lit(doublings)))
    return F.least((_col(base) * factor).cast("bigint"), _col(most).cast("bigint"))

def trigger_backoff(attempt, initial=200, most=5000, multiplier=2.0) -> Column:
    """A trigger's poll wait in ms: at least 50, multiplier between 1.1 and 10."""
    m = min(10.0, max(1.1, multiplier))
    wait = F.round(F.lit(float(initial)) * F.pow(F.lit(m), _col(attempt) - 1))
    return F.greatest(F.lit(50), F.least(wait, F.lit(float(most)))).cast("bigint")


def retry_after(base, most, elapsed) -> Column:
    """Seconds for a Retry-After header from ms: the base, 1 s if there is none, within both bounds, rounded up, at least 1."""
    wait = F.least(F.coalesce(_col(base), F.lit(1000)), _col(most), _col(elapsed))
    return F.greatest(F.lit(1), F.ceil(wait / 1000)).cast("bigint")

def jitter_bounds(delay, mode: str) -> tuple[Column, Column]:
    """Least and greatest wait under ``none``, ``equal`` or ``full`` jitter."""
    d = _col(delay).cast("double")
    return {"none": (d, d), "equal": (d / 2, d), "full": (F.lit(0.0), d)}[mode]


def jittered(delay, mode: str, draw: Column | None = None) -> Column:
    """A wait between the bounds; ``draw`` is a number from 0 to 1, by default random."""
    low, high = jitter_bounds(delay, mode)
    return low + (high - low) * (F.rand() if draw is None else draw)

def rfc3339(c) -> Column:
    """A timestamp without zone as RFC 3339 text in UTC."""
    return F.date_format(_col(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def payload_text(c) -> Column:
    """Payload bytes of a variant as text: strings as they are, null as none, others as JSON."""
    v = _col(c)
    return F.when(F.is_variant_null(v), F.lit(None)).when(
        F.schema_of_variant(v) == "STRING", v.cast("string")
    ).otherwise(F.to_json(v))


def payload_bytes(c) -> Column:
    """Bytes of a payload variant: those of an encoded payload, none for null, a text's own, else JSON."""
    v = _col(c)
    packed = F.try_variant_get(v, "$.binary", "string")
    envelope = F.coalesce(F.try_variant_get(v, "$.codec", "string").isNotNull() & packed.isNotNull(), F.lit(False))
    return F.when(envelope, F.try_to_binary(packed, F.lit("base64"))).otherwise(payload_text(v).cast("binary"))


def http_status(code) -> Column:
    """Response status of an outcome code."""
    table = {
        "ROUTE_UNKNOWN": 404, "METHOD_MISMATCH": 405, "PAYLOAD_TOO_LARGE": 413, "MISSING_KEY": 400,
        "LIMITS_ENFORCED": 429, "ROUTE_QUEUE_FULL": 429, "TARGET_UNAVAILABLE": 503,
        "BUDGET_EXHAUSTED": 503, "CONNECTOR_FAILURE": 502, "INTERNAL": 500,
    }
    out = F.lit(202)
    for name, status in table.items():
        out = F.when(_col(code) == name, F.lit(status)).otherwise(out)
    return out
