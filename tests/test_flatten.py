"""Flattening of variants: one pass over the rows, whatever they hold and however deep it lies."""

import json

from pyspark.sql import functions as F

from weirflow.operators import records


def _walk(value, path):
    yield path, value
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from _walk(inner, f"{path}.{name}")
    elif isinstance(value, list):
        for i, inner in enumerate(value):
            yield from _walk(inner, f"{path}[{i}]")


def _flat(rows, **options):
    out = records.flatten_json(rows.select("id", F.try_parse_json("text").alias("v")), "v", ["id"], **options)
    assert out.columns == ["id", "path", "node"]
    return out


def test_every_node_of_odd_documents(spark):
    deep = "x"
    for i in range(120):
        deep = {"a": deep} if i % 2 else [0, deep]
    documents = [
        {"a:": {"": [[], {}, [[1, -2.5, None]]]}, 'q"\\\n': {"{[,:]}": 'a"\\:,{['}, "ключ": "значение\U0001f600", "k": True},
        [[], [[]], "", "{}", "a:", {"b": False}], 7, "x:", "", None, {}, [], deep,
    ]
    rows = spark.createDataFrame(
        [(i, json.dumps(d)) for i, d in enumerate(documents)] + [(90, None), (91, "{")], "id long, text string"
    ).repartition(2)
    got = sorted((r.id, r.path, json.dumps(json.loads(r.node), sort_keys=True)) for r in _flat(rows).collect())
    wanted = sorted((i, p, json.dumps(v, sort_keys=True)) for i, d in enumerate(documents) for p, v in _walk(d, ".[0]"))
    assert got == wanted
    shallow = [r.path for r in _flat(rows.where("id = 1"), root=F.concat(F.lit("r"), "id"), depth=1).collect()]
    assert sorted(shallow) == ["r1", "r1[0]", "r1[1]", "r1[2]", "r1[3]", "r1[4]", "r1[5]"]
    assert {r.path for r in _flat(rows.where("id = 1"), root=F.lit(None).cast("string")).collect()} == {None}


def test_rows_are_read_once_and_without_a_count(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.lit('{"a":[{"b":1}]}').alias("text"))
    plan = _flat(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    stream = spark.readStream.format("rate").load().select(F.col("value").alias("id"), F.lit("[1]").alias("text"))
    assert _flat(stream).isStreaming


def test_nodes_leave_a_task_in_parts(spark, monkeypatch):
    monkeypatch.setattr(records, "_FLUSH", 10)
    rows = spark.createDataFrame([(1, json.dumps(list(range(50)))), (2, "{}")], "id long, text string").coalesce(1)
    got = {(r.id, r.path): r.node for r in _flat(rows).collect()}
    assert len(got) == 52 and got[1, ".[0][49]"] == "49" and got[2, ".[0]"] == "{}"
