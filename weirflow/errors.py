"""Error kinds by layer, and the canonical code that a caller sees for each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of each layer; a code where one is defined, else INTERNAL.
KINDS: dict[str, dict[str, str]] = {
    "expression": {
        "InvalidExpression": "INTERNAL", "MissingSlot": "MISSING_KEY", "MissingPath": "MISSING_KEY", "TypeMismatch": "INTERNAL",
        "NoResults": "INTERNAL", "MultipleResults": "INTERNAL", "Runtime": "INTERNAL",
    },
    "engine": {
        "UnknownRoute": "ROUTE_UNKNOWN", "MissingOption": "INTERNAL", "InvalidPhaseOptions": "INTERNAL", "MissingConnector": "INTERNAL",
        "UnsupportedPhase": "INTERNAL", "UnknownFallbackPhase": "INTERNAL", "RouteBackpressure": "LIMITS_ENFORCED",
        "RouteQueueOverflow": "ROUTE_QUEUE_FULL", "SchemaResolution": "INTERNAL", "Serialization": "INTERNAL",
    },
    "dispatch": {
        "ActionFailed": "CONNECTOR_FAILURE", "RetryBudgetExhausted": "BUDGET_EXHAUSTED", "FeatureDisabled": "CONNECTOR_FAILURE",
        "Unsupported": "CONNECTOR_FAILURE",
    },
    "handler": {
        "InvalidConfiguration": "INTERNAL", "InvalidInput": "INTERNAL", "Transport": "CONNECTOR_FAILURE", "Context": "MISSING_KEY",
    },
    "factory": {"BuildFailed": "TARGET_UNAVAILABLE", "Unavailable": "TARGET_UNAVAILABLE"},
    "readiness": {"RouteUnknown": "ROUTE_UNKNOWN", "InvalidTransition": "INTERNAL", "NotReady": "TARGET_UNAVAILABLE"},
}


def layer_of(kind: str) -> str | None:
    """The layer that a kind of error comes from."""
    return next((layer for layer, kinds in KINDS.items() if kind in kinds), None)


def canonical_code(kind: Column) -> Column:
    """The canonical code of an error kind; null without one, INTERNAL for unknown ones."""
    codes = {name: code for kinds in KINDS.values() for name, code in kinds.items() if code != "INTERNAL"}
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.when(kind.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*pairs), kind), F.lit("INTERNAL")))
