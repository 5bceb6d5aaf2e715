"""The routes that the catalogue runs, and the events that feed them: parcels that depots scan."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.config.loader import Document, load
from weirflow.functions import scalars

TEXT = """
api_version: v1
app:
  min_ready_routes: 2
  half_open_counts_as_ready: route
  feature_flags: [rabbitmq, mqtt, mongodb, redis, parallel_phase, serialize_phase]
  limits: {routes: {max_inflight: 64, overflow_policy: queue, max_queue_depth: 128}}
  retry_budget: {max_attempts: 6, max_elapsed: 40s, base_backoff: 20ms, max_backoff: 2s, jitter: equal}
connectors:
  - {name: dock, type: http, options: {role: server, port: 8080}}
  - {name: customs, type: http, options: {role: client, base_url: "http://customs.example/api/", default_headers: {x-desk: parcels}}}
  - {name: belt, type: kafka, options: {brokers: "belt-1:9092, belt-2:9092"}}
  - {name: yard, type: rabbitmq, options: {url: "amqp://yard.example"}}
  - {name: scale, type: mqtt, options: {url: "mqtt://scale.example"}}
  - {name: shelf, type: mariadb, options: {url: "mysql://shelf.example"}}
  - {name: ledger, type: postgres, options: {url: "postgres://ledger.example", schema: weights}}
  - {name: folder, type: mongodb, options: {uri: "mongodb://folder.example", database: parcels}}
  - {name: board, type: redis, options: {url: "redis://board.example"}}
  - {name: desk, type: smtp, options: {host: desk.example}}
  - {name: tariff, type: grpc, options: {endpoint: "http://tariff.example"}}
routes:
  - name: accept_parcel
    trigger: {connector: dock, options: {method: POST, path: /parcels}}
    phases:
      - name: label
        type: transform
        options: {parcel: ".[0].body.record.id", grams: $.0.body.scan.grams, lane.kind: ".[0].body.scan.kind", lane.trace: ".[0].header.trace_id"}
      - name: onto_belt
        type: kafka_producer
        options: {connector: belt, topic: parcels.accepted, key: ".[1].lane.kind", payload: ".[1]", acks: all}
      - name: receipt
        type: transform
        options: {status: 202, contentType: application/json, body.parcel: ".[1].parcel", body.belts: ".[2].count"}
  - name: declare_parcel
    trigger: {connector: belt, kafka: {topic: parcels.accepted, group_id: customs}}
    phases:
      - name: declare
        type: http_client
        options: {connector: customs, method: put, path: declarations, body: {goods: ".[0].body.scan", weight_known: true}, header.x_lane: ".[0].header.trace_id", timeout: 2s}
      - name: answer
        type: transform
        options: {goods: ".[0].body.scan.kind", verdict: ".[1] // \\"open\\""}
  - name: store_parcel
    trigger: {connector: dock, options: {path: /shelves}}
    phases:
      - name: place
        type: transform
        options: {shelf: ".[0].body.depot", grams: ".[0].body.scan.grams"}
      - name: put
        type: mariadb_idempotent_insert
        options: {connector: shelf, key: ".[1].shelf"}
  - name: announce_parcel
    trigger: {connector: dock, options: {path: /announcements}}
    phases:
      - name: note
        type: smtp_send
        options:
          connector: desk
          from: depot@example.org
          reply_to: lost@example.org
          to.0: .[0].body.mail
          cc: "archive@example.org; archive@example.org"
          subject: "Parcel .[0].body.record.id weighs .[0].body.scan.grams g"
          body: "Lane: .[0].body.scan.kind"
  - name: inspect_parcel
    trigger: {connector: yard, options: {queue: inspections}}
    phases:
      - name: weigh
        type: transform
        options: {parcel: ".[0].body.record.id", heavy: ".[0].body.scan.grams > 5000", spare: ".[0].body.scan.grams - 1"}
      - name: ask
        type: http_client
        options: {connector: customs, path: /inspections, body: ".[1]"}
      - name: shout
        type: rabbitmq
        options: {connector: yard, exchange: inspections, routing_key: "parcel.seen", body: ".[1]"}
  - name: watch_scale
    trigger: {connector: scale, options: {topic: "scales/#", qos: 1}}
    phases:
      - name: weight
        type: transform
        options: {topic: ".[0].topic", raw: ".[0].payload.base64"}
      - name: mirror
        type: mqtt
        options: {connector: scale, topic: "scales/mirror", qos: "1", retain: "yes", payload: ".[1].raw", payload_encoding: base64}
      - name: book
        type: postgres_idempotent_insert
        options: {connector: ledger, sql: "insert into weighings values (:topic, :raw)", values: ".[1]"}
  - name: file_parcel
    trigger: {connector: dock, options: {path: /files}}
    phases:
      - name: sheet
        type: mongodb
        options: {connector: folder, collection: sheets, operation: insert_one, document.id: ".[0].body.record.id"}
      - name: show
        type: redis
        options: {connector: board, command: HSET, key: "shown", field: ".[0].body.record.id", value: "filed"}
      - name: price
        type: grpc_client
        options: {connector: tariff, rpc: "tariff.Prices/Quote", request: ".[0].body.record"}
  - name: split_parcel
    trigger: {connector: dock, options: {path: /splits}}
    phases:
      - name: both
        type: parallel
        options:
          aggregation: any
          phases:
            - {name: copy, type: kafka_producer, options: {connector: belt, topic: copies, payload: ".[0].body.scan"}}
            - {name: fragile, type: kafka_producer, optional: true, fallback: copy, timeout: 1s, options: {connector: belt, topic: fragile, payload: ".[0].body.scan.care"}}
      - name: after
        type: kafka_producer
        options: {connector: belt, topic: after, payload: ".[0].body.depot"}
    policy:
      limits: {max_inflight: 8}
      fallback: {belt: after}
  - name: pack_parcel
    trigger: {connector: dock, options: {path: /packs}}
    phases:
      - name: pick
        type: transform
        options: {kind: ".[0].body.scan.kind"}
      - name: pack
        type: serialize
        options: {codec: cbor}
"""


@functools.cache
def document() -> Document:
    return load(TEXT)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parcel_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, s0``: requests about scanned parcels; every 7th has no weight, every third no care."""
    events = table(spark, sf_dir, "events")
    grams = F.when(F.col("event_id") % 7 != 0, F.floor(F.col("value") * 100).cast("bigint"))
    care = F.when(F.col("user_id") % 3 != 0, F.lit("soft"))
    scan = F.struct(F.col("event_type").alias("kind"), grams.alias("grams"), care.alias("care"), scalars.rfc3339("ts").alias("at"))
    record = F.struct(F.concat(F.lit("p-"), F.col("event_id").cast("string")).alias("id"))
    depot = F.col("user_id").cast("string")
    body = F.struct(
        F.col("user_id").alias("depot"), F.concat(F.lit("depot"), depot, F.lit("@example.org, desk@example.org")).alias("mail"),
        record.alias("record"), scan.alias("scan"),
    )
    header = F.struct(F.concat(F.lit("t-"), depot).alias("trace_id"))
    # JSON leaves absent fields out, which a struct cannot
    text = F.to_json(F.struct(header.alias("header"), body.alias("body")))
    return events.select("event_id", "user_id", F.parse_json(text).alias("s0"))
