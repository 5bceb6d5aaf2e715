"""Dotted option keys: flat to nested and back."""

from __future__ import annotations

from typing import Any


def expand(flat: dict[str, Any]) -> Any:
    """Nested options of dotted keys; levels with the keys 0, 1, ... become lists."""
    tree: dict[str, Any] = {}
    for key, value in flat.items():
        node = tree
        parts = str(key).split(".")
        for part in parts[:-1]:
            node = node.setdefault(part, {})
            if not isinstance(node, dict):
                raise ValueError(f"option {key!r} lies below a plain value")
        value = expand(value) if isinstance(value, dict) else value
        if isinstance(node.get(parts[-1]), dict) and isinstance(value, dict):
            node[parts[-1]] |= value
        elif parts[-1] in node:
            raise ValueError(f"option {key!r} is given twice")
        else:
            node[parts[-1]] = value
    return _lists(tree)


def _lists(node: Any) -> Any:
    if not isinstance(node, dict):
        return node
    inner = {k: _lists(v) for k, v in node.items()}
    if inner and set(inner) == {str(i) for i in range(len(inner))}:
        return [inner[str(i)] for i in range(len(inner))]
    return inner


def flatten(tree: Any, prefix: str = "") -> dict[str, Any]:
    """Dotted keys of nested options; list places become numbers."""
    if isinstance(tree, dict):
        pairs = list(tree.items())
    elif isinstance(tree, list):
        pairs = list(enumerate(tree))
    else:
        return {prefix: tree}
    out: dict[str, Any] = {}
    for key, value in pairs:
        out |= flatten(value, f"{prefix}.{key}" if prefix else str(key))
    return out
