"""AMQP field values and JSON: each value carries a tag for its type."""

from __future__ import annotations

import base64
from typing import Any

_WHOLE = {"byte", "short", "int", "long", "ubyte", "ushort", "uint", "timestamp"}
_PROPERTIES = (
    "content_type", "content_encoding", "delivery_mode", "priority", "correlation_id", "reply_to", "expiration",
    "message_id", "timestamp", "type", "user_id", "app_id", "cluster_id",
)


def to_json(tag: str, value: Any) -> Any:
    """JSON of a tagged value: decimals as floats, bytes as text if UTF-8, else base64; tables and arrays inside."""
    if tag == "void" or value is None:
        return None
    if tag == "boolean":
        return bool(value)
    if tag in _WHOLE:
        return int(value)
    if tag in ("float", "double"):
        return float(value)
    if tag == "decimal":
        scale, digits = value
        return digits / 10**scale
    if tag == "bytes":
        raw = bytes(value)
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return base64.b64encode(raw).decode()
    if tag == "array":
        return [to_json(t, v) for t, v in value]
    if tag == "table":
        return {k: to_json(t, v) for k, (t, v) in value.items()}
    return str(value)


def from_json(value: Any) -> tuple[str, Any]:
    """The tagged value of JSON; whole numbers beyond 64 bits become text."""
    if value is None:
        return "void", None
    if isinstance(value, bool):
        return "boolean", value
    if isinstance(value, int):
        return ("long", value) if -(2**63) <= value < 2**63 else ("string", str(value))
    if isinstance(value, float):
        return "double", value
    if isinstance(value, list):
        return "array", [from_json(v) for v in value]
    if isinstance(value, dict):
        return "table", {str(k): from_json(v) for k, v in value.items()}
    return "string", str(value)


def properties(given: dict[str, Any]) -> dict[str, Any]:
    """The known message properties that are set, with delivery mode and priority as numbers 0 to 255."""
    out: dict[str, Any] = {}
    for name in _PROPERTIES:
        value = given.get(name)
        if value is None:
            continue
        if name in ("delivery_mode", "priority"):
            if not 0 <= int(value) <= 255:
                raise ValueError(f"{name} must lie between 0 and 255")
            out[name] = int(value)
        else:
            out[name] = int(value) if name == "timestamp" else str(value)
    return out
