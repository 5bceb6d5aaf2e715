"""Readers and writers of connectors: Spark options where Spark has the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weirflow.config.loader import Connector


def kafka_security(options: dict) -> str:
    """Security protocol by what is configured: TLS, SASL, both or none."""
    tls, sasl = bool(options.get("tls")), bool(options.get("sasl"))
    return {(True, True): "SASL_SSL", (True, False): "SSL", (False, True): "SASL_PLAINTEXT"}.get((tls, sasl), "PLAINTEXT")


def kafka_options(connector: Connector, idempotent: bool = False) -> dict[str, str]:
    """Spark options of a Kafka connector; unknown options pass through."""
    own = dict(connector.options)
    brokers = own.pop("brokers", [])
    brokers = [b.strip() for b in brokers.split(",")] if isinstance(brokers, str) else brokers
    out = {"kafka.bootstrap.servers": ",".join(b for b in brokers if b), "kafka.security.protocol": kafka_security(own)}
    for name in ("tls", "sasl", "create_topics_if_missing"):
        own.pop(name, None)
    out |= {f"kafka.{k}": str(v) for k, v in own.items()}
    if idempotent:
        out.setdefault("kafka.enable.idempotence", "true")
        out.setdefault("kafka.acks", "all")
    return out


def kafka_source(spark: SparkSession, connector: Connector, topic: str, group: str | None = None, most: int = 32) -> DataFrame:
    """Streaming reader of a topic; needs Spark's Kafka package. ``most`` bounds a trigger's offsets."""
    reader = spark.readStream.format("kafka").options(**kafka_options(connector))
    reader = reader.option("subscribe", topic).option("maxOffsetsPerTrigger", most)
    return (reader.option("kafka.group.id", group) if group else reader).load()


def files(spark: SparkSession, path: str, kind: str = "parquet", schema=None, stream: bool = False) -> DataFrame:
    """Events from files, as a batch or as a stream."""
    reader = (spark.readStream if stream else spark.read).format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def jdbc_options(connector: Connector, table: str) -> dict[str, str]:
    """JDBC options of a Postgres or MariaDB connector."""
    own = connector.options
    schema = own.get("schema")
    return {"url": str(own["url"]), "dbtable": f"{schema}.{table}" if schema else table}
