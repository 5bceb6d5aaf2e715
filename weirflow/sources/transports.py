"""Streaming sources of brokers as one Python data source with exchangeable drivers.

A driver is named by a path ``module:factory``, so the executors and the stream's
planner can build it: ``factory(options) -> Driver``. The journal driver reads a
folder of JSON lines and stands in for a broker in tests; drivers for real
brokers wrap their client packages, which are not needed here.

Offsets are kept in the checkpoint and acknowledged when a batch is committed, so
a message is acknowledged after what it caused.
"""

from __future__ import annotations

import importlib
import json
import os
from collections.abc import Iterator
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from weirflow.sources import envelopes

#: What a message of each transport has; bodies are base64 text on the wire of the source.
SCHEMAS = {
    "http": "method string, path string, headers array<struct<key:string,value:string>>, query string, body binary, content_type string, received_at string",
    "kafka": "topic string, partition int, offset long, timestamp long, key binary, value binary, headers array<struct<key:string,value:binary>>",
    "rabbitmq": "body binary, exchange string, routing_key string, delivery_tag long, redelivered boolean, timestamp long, headers string, properties string",
    "mqtt": "topic string, payload binary, qos int, retain boolean, packet_id int, timestamp long",
    "mongodb": "operation string, database string, collection string, key string, document string, wall_time timestamp, before string, update string, token string",
    "redis_pubsub": "channel string, payload binary, arrived long",
    "redis_stream": "stream string, id string, fields map<string,binary>, arrived long",
}


class Driver(Protocol):
    """A broker's client: messages have places from 0 on and are dictionaries of the transport's fields."""

    def fetch(self, start: int, most: int) -> list[dict[str, Any]]: ...

    def acknowledge(self, end: int) -> None: ...


class JournalDriver:
    """Messages from ``*.jsonl`` files of a folder in the order of their names; acknowledgements go to ``acknowledged``.

    Fields that hold bytes are text in the files.
    """

    def __init__(self, options: dict[str, str]):
        self._folder = options["path"]

    def fetch(self, start: int, most: int) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        seen = 0
        for name in sorted(n for n in os.listdir(self._folder) if n.endswith(".jsonl")):
            with open(os.path.join(self._folder, name), encoding="utf-8") as lines:
                for line in lines:
                    if seen >= start and len(out) < most:
                        out.append(json.loads(line))
                    seen += 1
        return out

    def acknowledge(self, end: int) -> None:
        with open(os.path.join(self._folder, "acknowledged"), "w", encoding="utf-8") as file:
            file.write(str(end))


def _driver(options: dict[str, str]) -> Driver:
    module, _, factory = options.get("driver", f"{__name__}:JournalDriver").partition(":")
    return getattr(importlib.import_module(module), factory)(options)


def _as_binary(value: Any) -> Any:
    return value.encode() if isinstance(value, str) else value


class BrokerReader(SimpleDataSourceStreamReader):
    """Reads from the committed place on, at most ``maxMessages`` a batch."""

    def __init__(self, options: dict[str, str], schema):
        self._options, self._schema = dict(options), schema
        self._most = int(options.get("maxMessages", options.get("maxmessages", 1024)))

    def initialOffset(self) -> dict[str, int]:
        return {"place": int(self._options.get("startingPlace", self._options.get("startingplace", 0)))}

    def _rows(self, messages: list[dict[str, Any]]) -> Iterator[tuple]:
        for message in messages:
            row = []
            for field in self._schema.fields:
                value, kind = message.get(field.name), field.dataType.simpleString()
                if kind == "binary":
                    value = _as_binary(value)
                elif kind == "map<string,binary>":
                    value = {k: _as_binary(v) for k, v in (value or {}).items()}
                elif kind.startswith("array<struct"):
                    binary = kind.endswith("value:binary>>")
                    value = [(p["key"], _as_binary(p["value"]) if binary else p["value"]) for p in value or []]
                row.append(value)
            yield tuple(row)

    def read(self, start: dict[str, int]) -> tuple[Iterator[tuple], dict[str, int]]:
        messages = _driver(self._options).fetch(start["place"], self._most)
        return iter(list(self._rows(messages))), {"place": start["place"] + len(messages)}

    def readBetweenOffsets(self, start: dict[str, int], end: dict[str, int]) -> Iterator[tuple]:
        return iter(list(self._rows(_driver(self._options).fetch(start["place"], end["place"] - start["place"]))))

    def commit(self, end: dict[str, int]) -> None:
        _driver(self._options).acknowledge(end["place"])


class BrokerSource(DataSource):
    """``format("weirflow_broker")`` with the options ``transport``, ``driver`` and those of the driver."""

    @classmethod
    def name(cls) -> str:
        return "weirflow_broker"

    def schema(self) -> str:
        return SCHEMAS[self.options["transport"]]

    def simpleStreamReader(self, schema) -> BrokerReader:
        return BrokerReader(self.options, schema)


def messages(spark: SparkSession, transport: str, **options: str) -> DataFrame:
    """A stream of a transport's messages."""
    spark.dataSource.register(BrokerSource)
    return spark.readStream.format("weirflow_broker").options(transport=transport, **options).load()


def slot(transport: str) -> F.Column:
    """Slot 0 of a transport's message columns."""
    c = F.col
    return {
        "http": lambda: envelopes.http(c("method"), c("path"), c("headers"), c("query"), c("body"), c("received_at"), c("content_type")),
        "kafka": lambda: envelopes.kafka(c("topic"), c("partition"), c("offset"), c("timestamp"), c("key"), c("value"), c("headers")),
        "rabbitmq": lambda: envelopes.rabbitmq(
            c("body"), c("exchange"), c("routing_key"), c("delivery_tag"), c("redelivered"), c("timestamp"),
            F.try_parse_json("headers"), F.try_parse_json("properties"),
        ),
        "mqtt": lambda: envelopes.mqtt(c("topic"), c("payload"), c("qos"), c("retain"), c("packet_id"), c("timestamp")),
        "mongodb": lambda: envelopes.mongodb(
            c("operation"), c("database"), c("collection"), c("key"), c("document"), c("wall_time"), c("before"), c("update"), token=c("token")
        ),
        "redis_pubsub": lambda: envelopes.redis_pubsub(c("channel"), c("payload"), c("arrived")),
        "redis_stream": lambda: envelopes.redis_stream(c("stream"), c("id"), c("fields"), c("arrived")),
    }[transport]()


def trigger(spark: SparkSession, transport: str, **options: str) -> DataFrame:
    """The events that a trigger gives a route: the messages with their envelope in ``s0``."""
    rows = messages(spark, transport, **options)
    if transport == "mqtt":
        rows = envelopes.without_retained(rows, options.get("retain_handling", 0))
    return rows.withColumn("s0", slot(transport))
