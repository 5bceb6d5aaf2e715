"""Streams: triggers with a journal for a broker, folds across batches, sinks that take a batch twice."""

import json
import time

import pytest
from pyspark.sql import functions as F

from weirflow.operators.health import Breaker, BudgetTracker
from weirflow.plans.route import compile_route, dispatchable
from weirflow.queries.document import document
from weirflow.sources import transports
from weirflow.streaming import sinks, stateful

MESSAGES = {
    "http": {
        "method": "POST", "path": "/parcels", "headers": [{"key": "Trace-Id", "value": "t"}], "query": "a=1&a=2", "body": '{"x":1}',
        "content_type": "application/json", "received_at": "2024-01-01T00:00:00Z",
    },
    "kafka": {"topic": "t", "partition": 0, "offset": 4, "key": "k", "value": '{"body":{"x":1}}', "headers": [{"key": "H", "value": "v"}]},
    "rabbitmq": {"body": '{"x":1}', "exchange": "e", "routing_key": "r", "delivery_tag": 1, "redelivered": False, "headers": '{"h":1}', "properties": '{"type":"p"}'},
    "mqtt": {"topic": "t", "payload": "hot", "qos": 1, "retain": False, "packet_id": 3},
    "mongodb": {"operation": "insert", "database": "d", "collection": "c", "key": "1", "document": '{"x":1}', "update": '{"u":1}', "token": '{"t":1}'},
    "redis_pubsub": {"channel": "c", "payload": "p", "arrived": 5},
    "redis_stream": {"stream": "s", "id": "1-0", "fields": {"payload": "p", "timestamp": "77", "a": "b"}, "arrived": 5},
}
WANTED = {
    "http": {"$.body.x": "1", "$.query.a[1]": "2", "$.headers.trace_id": "t", "$.metadata.received_at": "2024-01-01T00:00:00Z"},
    "kafka": {"$.body.x": "1", "$.key.text": "k", "$.headers.h": "v", "$.offset": "4"},
    "rabbitmq": {"$.body.json.x": "1", "$.headers.h": "1", "$.properties.type": "p"},
    "mqtt": {"$.payload.text": "hot", "$.metadata.packet_id": "3"},
    "mongodb": {"$.fullDocument.x": "1", "$.updateDescription.u": "1", "$.metadata.resumeToken.t": "1"},
    "redis_pubsub": {"$.payload.text": "p", "$.metadata.timestamp": "5"},
    "redis_stream": {"$.attributes.a": "b", "$.metadata.timestamp": "77", "$.payload.text": "p"},
}


def _journal(folder, rows, name="0001.jsonl"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return str(folder)


def _drain(query):
    query.awaitTermination(120)
    assert not query.isActive
    assert query.exception() is None


@pytest.mark.parametrize("transport", sorted(MESSAGES))
def test_trigger(spark, tmp_path, transport):
    path = _journal(tmp_path / "in", [MESSAGES[transport]] * 2)
    events = transports.trigger(spark, transport, path=path)
    shown = events.select(*(F.try_variant_get("s0", p, "string").alias(f"c{i}") for i, p in enumerate(WANTED[transport])))
    writer = shown.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
    _drain(writer.trigger(availableNow=True).start(str(tmp_path / "out")))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [tuple(r) for r in rows] == [tuple(WANTED[transport].values())] * 2


def test_messages_are_read_once_and_acknowledged(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        events = transports.messages(spark, "mqtt", path=str(folder), maxMessages="2").select("topic")
        _drain(events.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out))
        return sorted(r.topic for r in spark.read.parquet(out).collect())

    _journal(folder, [MESSAGES["mqtt"] | {"topic": f"t{i}"} for i in range(3)])
    first = run()
    _journal(folder, [MESSAGES["mqtt"] | {"topic": "later"}], "0002.jsonl")
    for _ in range(4):
        second = run()
    assert set(first) <= {"t0", "t1", "t2"} and second == ["later", "t0", "t1", "t2"]
    # the last batch is acknowledged when the next one begins
    assert int((folder / "acknowledged").read_text()) >= 2


def test_retained_messages_are_ignored(spark, tmp_path):
    path = _journal(tmp_path / "in", [MESSAGES["mqtt"], MESSAGES["mqtt"] | {"retain": True}])
    events = transports.trigger(spark, "mqtt", path=path, retain_handling="1").select("topic")
    out = str(tmp_path / "out")
    _drain(events.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out))
    assert spark.read.parquet(out).count() == 1


def _files(spark, tmp_path, rows, schema, batches=1):
    folder = tmp_path / "files"
    for i in range(batches):
        part = rows[i * len(rows) // batches : (i + 1) * len(rows) // batches]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_route_over_a_stream_is_delivered_once(spark, tmp_path):
    """The same route as in batch; bad events go to the error sink, a repeated batch changes nothing."""
    good = {"header": {"trace_id": "t"}, "body": {"record": {"id": "p"}, "scan": {"kind": "air", "grams": 3}}}
    bad = {"header": {"trace_id": "t"}, "body": {"record": {"id": "q"}}}
    rows = [(i, json.dumps(bad if i == 2 else good)) for i in range(6)]
    events = _files(spark, tmp_path, rows, "event_id long, text string", 2).select("event_id", F.parse_json("text").alias("s0"))
    routed = compile_route(document(), "accept_parcel")(events)
    actions = routed.select("event_id", "error", F.explode_outer("actions").alias("a")).select("event_id", "error", "a.*")
    ledger = sinks.Ledger(spark, str(tmp_path / "ledger"))
    wrong = []
    table = sinks.table_sink(ledger, str(tmp_path / "table"))

    def twice(batch, number):
        table(batch, number)
        table(batch, number)

    def errors(batch, number):
        wrong.extend(r.event_id for r in batch.collect())

    _drain(stateful.deliver(actions, {"kafka": twice, "error": errors}, str(tmp_path / "cp"), availableNow=True))
    assert wrong == [2]
    sent = spark.read.parquet(str(tmp_path / "table"))
    assert sorted(r.event_id for r in sent.collect()) == [0, 1, 3, 4, 5]
    assert ledger.delivered().count() == 5


def test_sinks_do_not_repeat_effects(spark, tmp_path):
    rows = [(1, 0, "kafka", "a", "x"), (1, 1, "kafka", "b", "y"), (2, 0, "kafka", "a", "z")]
    actions = spark.createDataFrame(rows, "event_id long, idx int, kind string, target string, payload string")
    upsert = sinks.upsert_sink(sinks.Ledger(spark, str(tmp_path / "l1")), spark, str(tmp_path / "state"))
    upsert(actions.where("event_id = 1"), 0)
    upsert(actions.where("event_id = 2"), 1)
    upsert(actions.where("event_id = 2"), 1)
    assert {r.key: r.value for r in sinks.latest(spark, str(tmp_path / "state")).collect()} == {"a": "z", "b": "y"}
    log = str(tmp_path / "sent")

    def send(batch):
        with open(log, "a", encoding="utf-8") as file:
            file.writelines(f"{a['event_id']}-{a['idx']}\n" for a in batch)

    call = sinks.call_sink(sinks.Ledger(spark, str(tmp_path / "l2")), send)
    call(actions, 0)
    call(actions, 1)  # another batch brings the same actions: none is sent again
    assert sorted(open(log, encoding="utf-8").read().split()) == ["1-0", "1-1", "2-0"]


def test_breaker_across_batches(spark, tmp_path):
    rows = [("e", 100 * i, i, ok) for i, ok in enumerate([True, False, False, True, True, False, True, True])]
    schema = "endpoint string, at_ms long, seq long, ok boolean"
    out = stateful.breaker_stream(_files(spark, tmp_path, rows, schema, 4), 0.6, 1000, 150, 1000)
    query = out.writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "cp"))
    _drain(query.trigger(availableNow=True).start())
    got = [r.state for r in spark.table("breaker").orderBy("seq").collect()]
    breaker = Breaker(0.6, 1000, 150, 1000)
    assert got == [breaker.observe(t, ok) for _, t, _, ok in rows]
    assert {"HEALTHY", "CB_OPEN"} <= set(got)


def test_breaker_timer_fires_without_an_outcome(spark, tmp_path):
    now = int(time.time() * 1000)
    rows = [("e", now, 0, False)]
    events = _files(spark, tmp_path, rows, "endpoint string, at_ms long, seq long, ok boolean")
    out = stateful.breaker_stream(events, 0.5, 10_000, 500, 500, timers=True)
    query = out.writeStream.format("memory").queryName("timer").option("checkpointLocation", str(tmp_path / "cp"))
    running = query.trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            states = [r.state for r in spark.table("timer").collect()]
            if "CB_HALF_OPEN" in states:
                break
            time.sleep(0.5)
    finally:
        running.stop()
    assert states == ["CB_OPEN", "CB_HALF_OPEN"]


def test_budget_across_batches(spark, tmp_path):
    rows = [("r", t, i) for i, t in enumerate([0, 10, 20, 30, 200, 210])]
    out = stateful.budget_stream(_files(spark, tmp_path, rows, "route string, at_ms long, seq long", 3), 2, 100)
    query = out.writeStream.format("memory").queryName("budget").option("checkpointLocation", str(tmp_path / "cp"))
    _drain(query.trigger(availableNow=True).start())
    got = [(r.used, r.exhausted) for r in spark.table("budget").orderBy("seq").collect()]
    assert got == [(1, False), (2, False), (3, True), (4, True), (1, False), (2, False)]


def test_first_seen_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:06")]
    events = _files(spark, tmp_path, rows, "key int, at string").withColumn("at", F.col("at").cast("timestamp"))
    out = stateful.first_seen_stream(events, ["key"], "at", "1 hour")
    query = out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp"))
    _drain(query.trigger(availableNow=True).start())
    assert sorted(r.key for r in spark.table("seen").collect()) == [1, 2]


def test_breaker_by_hand():
    breaker = Breaker(0.5, 1000, 100, 300)
    assert [breaker.observe(t, ok) for t, ok in [(0, True), (1, False)]] == ["HEALTHY", "CB_OPEN"]
    assert breaker.observe(50, True) == "CB_OPEN"  # still open
    assert breaker.observe(101, False) == "CB_OPEN" and breaker.until == 301  # half-open, failed: twice the wait
    assert breaker.observe(301, True) == "HEALTHY" and breaker.events == [] and breaker.backoff == 100
    assert breaker.observe(302, False) == "CB_OPEN" and breaker.until == 402
    plain = Breaker()
    assert [plain.observe(t, ok) for t, ok in [(0, False), (1, True), (2, False)]] == ["UNHEALTHY", "HEALTHY", "UNHEALTHY"]
    calm = Breaker(0.9, 1000, 100, 100)
    assert [calm.observe(t, ok) for t, ok in [(0, True), (1, True), (2, False), (3, True)]] == ["HEALTHY", "HEALTHY", "UNHEALTHY", "HEALTHY"]
    assert calm.events == []  # back to healthy: the window is cleared


def test_budget_without_bounds():
    tracker = BudgetTracker(None, None)
    assert [tracker.attempt(t) for t in (0, 5)] == [(1, False), (2, False)]


def test_dispatchable_keeps_order(spark):
    events = spark.range(1).select(F.col("id").alias("event_id"), F.parse_json(F.lit('{"body":{"record":{"id":"p"}}}')).alias("s0"))
    rows = dispatchable(compile_route(document(), "file_parcel")(events)).collect()
    assert [(r.idx, r.kind) for r in rows] == [(0, "mongodb"), (1, "redis"), (2, "grpc")]
