"""Queries over compiled routes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.operators import records
from weirflow.plans.route import compile_route, dispatchable, response_status
from weirflow.queries.document import document, parcel_events, table
from weirflow.sources import envelopes


def _run(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return compile_route(document(), name)(parcel_events(spark, sf_dir))


def _json(column: str, path: str) -> F.Column:
    return F.get_json_object(column, path)


def collect_record(spark, sf_dir):
    rows = response_status(_run(spark, sf_dir, "accept_parcel"))
    return rows.select(
        "event_id",
        F.col("status").cast("int").alias("status"),
        F.col("error.code").alias("error_code"),
        F.col("error.phase").alias("error_phase"),
        F.size(F.coalesce("actions", F.expr("array()"))).cast("long").alias("n_actions"),
        F.try_variant_get("s1", "$.grams", "long").alias("grams"),
        F.try_variant_get("s1", "$.lane.trace", "string").alias("lane_trace"),
        _json("response.body", "$.parcel").alias("parcel"),
        _json(F.expr("actions[0].extra"), "$.acks").alias("acks"),
        "trace_id",
        "record_id",
    )


_GRAMS = "case when event_id % 7 = 0 then null else cast(floor(value * 100) as bigint) end"

COLLECT = f"""
select event_id, cast(case when event_id % 7 = 0 then 400 else 202 end as integer) as status,
  case when event_id % 7 = 0 then 'MISSING_KEY' end as error_code,
  case when event_id % 7 = 0 then 'label' end as error_phase,
  cast(case when event_id % 7 = 0 then 0 else 1 end as bigint) as n_actions,
  {_GRAMS} as grams,
  case when event_id % 7 <> 0 then 't-' || user_id end as lane_trace,
  case when event_id % 7 <> 0 then 'p-' || event_id end as parcel,
  case when event_id % 7 <> 0 then 'all' end as acks,
  't-' || user_id as trace_id, 'p-' || event_id as record_id
from events
"""


def relay_record(spark, sf_dir):
    rows = dispatchable(_run(spark, sf_dir, "declare_parcel"))
    return rows.select(
        "event_id", "idx", "phase", "kind", "connector", "target",
        _json("payload", "$.header.x_lane").alias("x_lane"),
        _json("payload", "$.body.goods.kind").alias("goods"),
        _json("extra", "$.timeout_ms").cast("long").alias("timeout_ms"),
        F.try_variant_get("s2", "$.verdict", "string").alias("verdict"),
    )


RELAY = """
select event_id, 0 as idx, 'declare' as phase, 'http' as kind, 'customs' as connector, 'PUT /declarations' as target,
  't-' || user_id as x_lane, event_type as goods, 2000::bigint as timeout_ms, 'open' as verdict
from events
"""


def persist_record(spark, sf_dir):
    actions = dispatchable(_run(spark, sf_dir, "store_parcel"))
    writes = actions.select(
        F.col("target").alias("shelf"), "event_id", _json("payload", "$.grams").cast("long").alias("grams")
    )
    return records.upsert_last(writes, ["shelf"], ["event_id"])


PERSIST = f"""
select cast(user_id as varchar) as shelf, event_id, {_GRAMS} as grams
from events where event_id % 7 <> 0
qualify row_number() over (partition by user_id order by event_id desc) = 1
"""


def notify_mail(spark, sf_dir):
    rows = dispatchable(_run(spark, sf_dir, "announce_parcel"))
    return rows.select(
        "event_id", "target", _json("payload", "$.subject").alias("subject"), _json("payload", "$.body").alias("body"),
        F.try_variant_get("s1", "$.recipients", "int").alias("recipients"), _json("extra", "$.reply_to").alias("reply_to"),
    )


NOTIFY = """
select event_id, 'depot' || user_id || '@example.org,desk@example.org,archive@example.org' as target,
  'Parcel p-' || event_id || ' weighs ' || cast(floor(value * 100) as bigint) || ' g' as subject,
  'Lane: ' || event_type as body, 3 as recipients, 'lost@example.org' as reply_to
from events where event_id % 7 <> 0
"""


def alert_pipeline(spark, sf_dir):
    rows = dispatchable(_run(spark, sf_dir, "inspect_parcel"))
    return rows.select(
        "event_id", "idx", "kind", "target",
        F.try_variant_get("s1", "$.heavy", "boolean").alias("heavy"),
        F.try_variant_get("s1", "$.spare", "long").alias("spare"),
        F.try_variant_get("s3", "$.status", "string").alias("state"),
        F.try_variant_get("s3", "$.confirm", "boolean").alias("confirm"),
    )


ALERT = """
select event_id, x.idx, x.kind, x.target, floor(value * 100) > 5000 as heavy, cast(floor(value * 100) as bigint) - 1 as spare,
  'pending' as state, true as confirm
from events, (values (0, 'http', 'GET /inspections'), (1, 'rabbitmq', 'inspections/parcel.seen')) as x(idx, kind, target)
where event_id % 7 <> 0
"""


def sensor_ingest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    source = events.select(
        "event_id",
        F.col("event_id").alias("packet_seq"),
        envelopes.mqtt(
            F.concat(F.lit("scales/"), "event_type"), F.col("props").cast("binary"), F.lit(1), F.lit(False), F.lit(1)
        ).alias("s0"),
    )
    rows = compile_route(document(), "watch_scale")(source)
    return rows.select(
        "event_id",
        F.try_variant_get("s1", "$.topic", "string").alias("topic"),
        F.try_variant_get("s2", "$.payload_encoded", "string").alias("encoded"),
        F.try_variant_get("s2", "$.qos", "int").alias("qos"),
        F.try_variant_get("s2", "$.retain", "boolean").alias("retain"),
        F.try_variant_get("s2", "$.packet_id", "int").alias("packet"),
        _json(F.expr("actions[1].payload"), "$.topic").alias("stored_topic"),
        F.col("actions")[1]["kind"].alias("sink"),
    )


SENSOR = """
select event_id, 'scales/' || event_type as topic, to_base64(encode(props)) as encoded, 1 as qos, true as retain,
  cast(((event_id - 1) % 65535 + 65535) % 65535 + 1 as integer) as packet, 'scales/' || event_type as stored_topic, 'postgres' as sink
from events
"""


def audit_record(spark, sf_dir):
    rows = dispatchable(_run(spark, sf_dir, "file_parcel"))
    return rows.select(
        "event_id", "idx", "kind", "target",
        F.coalesce(_json("payload", "$.document.id"), _json("payload", "$.field"), _json("payload", "$.request.id")).alias("id"),
        F.try_variant_get("s1", "$.operation", "string").alias("operation"),
        F.is_variant_null(F.try_variant_get("s1", "$.matched_count", "variant")).alias("uncounted"),
    )


AUDIT = """
select event_id, x.idx, x.kind, x.target, 'p-' || event_id as id, 'insert_one' as operation, true as uncounted
from events, (values (0, 'mongodb', 'sheets'), (1, 'redis', 'hset'), (2, 'grpc', 'tariff.Prices/Quote')) as x(idx, kind, target)
"""


def fan_out(spark, sf_dir):
    rows = _run(spark, sf_dir, "split_parcel")
    inner = lambda path, kind: F.try_variant_get("s1", f"$.children.{path}", kind)
    return rows.select(
        "event_id",
        F.try_variant_get("s1", "$.aggregation_state", "string").alias("state"),
        inner("copy.status", "string").alias("copy"),
        inner("fragile.status", "string").alias("fragile"),
        inner("fragile.error", "string").alias("fragile_error"),
        inner("fragile.fallback", "string").alias("fallback"),
        inner("fragile.timeout_ms", "long").alias("timeout_ms"),
        inner("fragile.output.count", "int").alias("fragile_count"),
        F.size("actions").alias("n_actions"),
        F.array_join(F.transform("fallback_actions", lambda a: a["payload"]), ",").alias("spare"),
    )


FAN = """
select event_id, case when user_id % 3 = 0 then 'partial' else 'pending' end as state, 'pending' as copy,
  case when user_id % 3 = 0 then 'skipped' else 'pending' end as fragile,
  case when user_id % 3 = 0 then 'MissingPath' end as fragile_error, 'copy' as fallback, 1000::bigint as timeout_ms,
  case when user_id % 3 <> 0 then 1 end as fragile_count, case when user_id % 3 = 0 then 1 else 2 end as n_actions,
  '{"key":null,"value":"' || user_id || '"}' as spare
from events
"""


def pack_record(spark, sf_dir):
    rows = _run(spark, sf_dir, "pack_parcel")
    return rows.select(
        "event_id", F.try_variant_get("s2", "$.codec", "string").alias("codec"),
        F.try_variant_get("s2", "$.length", "long").alias("length"), F.try_variant_get("s2", "$.binary", "string").alias("body"),
    )


PACK = """
select event_id, 'cbor' as codec, cast(octet_length(b) as bigint) as length, to_base64(b) as body
from (select event_id, unhex('a1646b696e64' || printf('%02x', 96 + strlen(event_type)) || hex(encode(event_type))) as b from events)
"""

QUERIES = {
    "route_collect_record": collect_record,
    "route_relay_record": relay_record,
    "route_persist_record": persist_record,
    "route_notify_mail": notify_mail,
    "route_alert_pipeline": alert_pipeline,
    "route_sensor_ingest": sensor_ingest,
    "route_audit_record": audit_record,
    "route_fan_out": fan_out,
    "route_pack_record": pack_record,
}
ORACLES = {
    "route_collect_record": COLLECT,
    "route_relay_record": RELAY,
    "route_persist_record": PERSIST,
    "route_notify_mail": NOTIFY,
    "route_alert_pipeline": ALERT,
    "route_sensor_ingest": SENSOR,
    "route_audit_record": AUDIT,
    "route_fan_out": FAN,
    "route_pack_record": PACK,
}
