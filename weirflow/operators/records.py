"""Keyed effects on tables: upserts, documents, key-value state, document pipelines."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow.operators.folds import running_total


def upsert_last(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key: what an idempotent upsert leaves behind.

    A pre-aggregated ``max_by``, so a hot key never gathers its rows in a task.
    """
    others = [c for c in rows.columns if c not in keys]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("__last")
    return rows.groupBy(*keys).agg(last).select(*keys, "__last.*")


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``inserted`` and ``count``: true and 1 for each key's first row."""
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("__first"))
    joined = rows.join(first, keys)
    inserted = F.struct(*order) == F.col("__first")
    return joined.withColumns({"inserted": inserted, "count": inserted.cast("int")}).drop("__first")


def insert_rows(table: DataFrame, new: DataFrame) -> DataFrame:
    return table.unionByName(new)


def replace_rows(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` in place of those with their key; keys unknown to the table add nothing."""
    known = new.join(table.select(*keys), keys, "left_semi")
    return table.join(new.select(*keys), keys, "left_anti").unionByName(known)


def update_rows(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Fields of ``changes`` set in the rows they match; other rows stay."""
    fields = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *(F.col(c).alias(f"__{c}") for c in fields), F.lit(True).alias("__hit"))
    joined = table.join(renamed, keys, "left")
    new = {c: F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)) if c in table.columns else F.col(f"__{c}") for c in fields}
    return joined.withColumns(new).drop("__hit", *(f"__{c}" for c in fields))


def delete_rows(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


_COMPARE = {
    "$eq": lambda c, v: c == v, "$ne": lambda c, v: c != v, "$gt": lambda c, v: c > v, "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v, "$lte": lambda c, v: c <= v, "$in": lambda c, v: c.isin(v),
}


def _condition(spec: dict[str, Any]) -> Column:
    out = F.lit(True)
    for name, wanted in spec.items():
        if name in ("$and", "$or"):
            parts = [_condition(s) for s in wanted]
            joined = parts[0]
            for p in parts[1:]:
                joined = joined & p if name == "$and" else joined | p
            out = out & joined
        elif isinstance(wanted, dict):
            for op, value in wanted.items():
                out = out & _COMPARE[op](F.col(name), value)
        else:
            out = out & (F.col(name) == wanted)
    return out


def _operand(spec: Any) -> Column:
    return F.col(spec[1:]) if isinstance(spec, str) and spec.startswith("$") else F.lit(spec)


_FOLDS = {"$sum": F.sum, "$avg": F.avg, "$min": F.min, "$max": F.max}


def pipeline(rows: DataFrame, stages: list[dict[str, Any]]) -> DataFrame:
    """A document pipeline ($match, $project, $group, $unwind, $sort, $limit) as DataFrame operations."""
    for stage in stages:
        ((name, spec),) = stage.items()
        if name == "$match":
            rows = rows.where(_condition(spec))
        elif name == "$project":
            rows = rows.select(*(F.col(k) if v == 1 else _operand(v).alias(k) for k, v in spec.items() if v != 0))
        elif name == "$group":
            keys = spec["_id"] or {}
            keys = {"_id": keys} if isinstance(keys, str) else keys
            folds = []
            for field, fold in spec.items():
                if field != "_id":
                    ((op, operand),) = fold.items()
                    folds.append((F.count("*") if op == "$count" else _FOLDS[op](_operand(operand))).alias(field))
            rows = rows.groupBy(*(_operand(v).alias(k) for k, v in keys.items())).agg(*folds)
        elif name == "$unwind":
            field = spec[1:]
            rows = rows.withColumn(field, F.explode(field))
        elif name == "$sort":
            rows = rows.orderBy(*(F.col(k).asc() if v == 1 else F.col(k).desc() for k, v in spec.items()))
        elif name == "$limit":
            rows = rows.limit(int(spec))
        else:
            raise ValueError(f"unknown stage {name}")
    return rows


def key_values(writes: DataFrame, at: Column | None = None) -> DataFrame:
    """Live key-value pairs after ``writes(key, value, seq, expires)``; ``at`` drops what has expired."""
    state = writes.groupBy("key").agg(F.max_by(F.struct("value", "expires"), "seq").alias("last")).select("key", "last.*")
    return state if at is None else state.where(F.col("expires").isNull() | (F.col("expires") > at))


def hash_fields(writes: DataFrame) -> DataFrame:
    """State of hashes after ``writes(key, field, value, seq)``: the last value of each field."""
    return writes.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def unknown_references(used: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Names that ``used`` refers to and ``known`` does not have, with how often; a null name refers to nothing."""
    named = used.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return named.join(known.select(name).distinct(), name, "left_anti")


def enrich(rows: DataFrame, facts: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """``rows`` with the fields of ``facts``, a row for each key at most; ``MissingPath`` as error where there is none."""
    found = rows.join(facts.withColumn("__found", F.lit(True)), keys, "left")
    return found.withColumn(error, F.when(F.col("__found").isNull(), F.lit("MissingPath"))).drop("__found")


#: Brackets, names with their colon and scalars of compact JSON; commas lie between them.
_TOKEN = re.compile(r'[{}\[\]]|"[^"\\]*(?:\\.[^"\\]*)*":?|[^{}\[\],:"]+')
#: Characters of nodes that leave a flattening task at once.
_FLUSH = 1 << 22


def _nodes(text: str, path: str) -> Iterator[tuple[str, str, int]]:
    """``path, node, depth`` of each node of compact JSON below ``path``, inner ones first; a node is a slice of the text."""
    above: list[list] = []  # path, begin and next index of the open containers; no index in an object
    for found in _TOKEN.finditer(text):
        token = found[0]
        if token[0] == '"' and token[-1] == ":":
            name = token[1:-2]
            path = f"{above[-1][0]}.{json.loads(token[:-1]) if '\\' in name else name}"
        elif token == "}" or token == "]":
            own, begin, _ = above.pop()
            yield own, text[begin : found.end()], len(above)
        else:
            if above and above[-1][2] is not None:
                path = f"{above[-1][0]}[{above[-1][2]}]"
                above[-1][2] += 1
            if token == "{" or token == "[":
                above.append([path, found.start(), 0 if token == "[" else None])
            else:
                yield path, token, len(above)


def _batch(own: list[pa.Array], found: tuple[list, list, list], names: list[str]) -> pa.RecordBatch:
    at, places, nodes = (pa.array(part, kind) for part, kind in zip(found, (pa.int32(), pa.string(), pa.string()), strict=True))
    return pa.RecordBatch.from_arrays([*(c.take(at) for c in own), places, nodes], names=names)


def flatten_json(rows: DataFrame, value: str, keys: list[str], root: Column | str = ".[0]", depth: int | None = None) -> DataFrame:
    """``(keys, path, node)``: every node of a variant, containers and scalars, with its JSON text.

    Paths are ``root``, then ``.name`` and ``[index]``. Rows are read once, however
    deep they are; ``depth`` leaves out what lies deeper. A task holds one batch of
    documents and a few MB of nodes, or one node if that is more.
    """
    start = F.lit(root) if isinstance(root, str) else root
    texts = rows.where(F.col(value).isNotNull()).select(*keys, start.alias("path"), F.to_json(value).alias("node"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *own, paths, documents = batch.columns
            found, held = ([], [], []), 0
            for i, (path, document) in enumerate(zip(paths.to_pylist(), documents.to_pylist(), strict=True)):
                for place, node, level in _nodes(document, path or ""):
                    if depth is None or level <= depth:
                        found[0].append(i)
                        found[1].append(None if path is None else place)
                        found[2].append(node)
                        held += len(place) + len(node)
                        if held > _FLUSH:
                            yield _batch(own, found, batch.schema.names)
                            found, held = ([], [], []), 0
            yield _batch(own, found, batch.schema.names)

    return texts.mapInArrow(run, texts.schema)


def unflatten(nodes: DataFrame, keys: list[str], depth: int | None = None) -> DataFrame:
    """``(keys, value)``: the variant that ``nodes(keys, path, node)`` describe, a row for each key.

    Leaves decide; containers without inner nodes stay empty. Objects and arrays
    are put together from the deepest level up; an array's missing places are null.
    """
    steps = F.regexp_extract_all(F.regexp_replace("path", r"^\.\[[0-9]+\]", ""), F.lit(r"(\.[^.\[\]]+|\[[0-9]+\])"), 1)
    level = nodes.select(*keys, steps.alias("steps"), "node")
    if depth is None:
        depth = level.agg(F.max(F.size("steps"))).first()[0] or 0
    for size in range(depth, 0, -1):
        deep = level.where(F.size("steps") == size).withColumn("own", F.try_element_at("steps", F.lit(-1)))
        deep = deep.withColumn("steps", F.slice("steps", 1, size - 1))
        index = F.regexp_extract("own", r"([0-9]+)", 1).cast("int")
        entry = F.struct(index.alias("at"), "node")
        quoted = F.expr("regexp_extract(to_json(array(substring(own, 2))), '^.(.*).$', 1)")
        parts = deep.groupBy(*keys, "steps").agg(
            F.bool_or(F.col("own").startswith("[")).alias("is_array"),
            F.sort_array(F.collect_list(F.when(F.col("own").startswith("["), entry))).alias("items"),
            F.sort_array(F.collect_list(F.when(F.col("own").startswith("."), F.concat(quoted, F.lit(":"), "node")))).alias("fields"),
        )
        places = F.sequence(F.lit(0), F.coalesce(F.try_element_at("items", F.lit(-1))["at"], F.lit(0)))
        known = F.map_from_entries(F.transform("items", lambda x: F.struct(x["at"], x["node"])))
        array = F.array_join(F.transform(places, lambda i: F.coalesce(F.try_element_at(known, i), F.lit("null"))), ",")
        made = F.when(F.col("is_array"), F.concat(F.lit("["), array, F.lit("]"))).otherwise(
            F.concat(F.lit("{"), F.array_join("fields", ","), F.lit("}"))
        )
        built = parts.select(*keys, "steps", made.alias("built"))
        above = level.where(F.size("steps") < size)
        level = above.join(built, [*keys, "steps"], "full").select(*keys, "steps", F.coalesce("built", "node").alias("node"))
    return level.where(F.size("steps") == 0).select(*keys, F.parse_json("node").alias("value"))


def flatten_headers(pairs: Column, slot: int = 0) -> Column:
    """``map<path, value>`` of header pairs ``array<struct<name, value>>``, below ``headers`` and ``header``.

    Names are trimmed and lower-cased; the second of a name gets ``.1``, the third ``.2``.
    """
    clean = F.transform(pairs, lambda p: F.struct(F.lower(F.trim(p["name"])).alias("name"), p["value"].alias("value")))

    def entries(group: str) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(clean, 1, i), lambda q: q["name"] == p["name"]))
            suffix = F.when(before > 0, F.concat(F.lit("."), before.cast("string"))).otherwise(F.lit(""))
            return F.struct(F.concat(F.lit(f".[{slot}].{group}."), p["name"], suffix).alias("key"), p["value"].alias("value"))

        return F.transform(clean, one)

    return F.map_from_entries(F.concat(entries("headers"), entries("header")))


def bytes_entry(slot: int, path: str, value: Column) -> Column:
    """``struct(key, value)``: bytes as base64 text at a path of a slot."""
    inner = path.strip(".")
    return F.struct(F.lit(f".[{slot}].{inner}" if inner else f".[{slot}]").alias("key"), F.base64(value).alias("value"))


def number_in_order(rows: DataFrame, key: str, order: str, name: str, width: int = 1_000_000) -> DataFrame:
    """``rows`` with their number within the key; ``order`` is unique there, ``width`` of its units make a range."""
    return running_total(rows, key, order, F.lit(1).cast("long"), width, name)
