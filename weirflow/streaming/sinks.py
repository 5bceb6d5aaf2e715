"""Sinks of emitted actions: each takes a batch again after a failure without repeating its effect."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sends actions, given as dictionaries; an exception makes the batch be sent again.
Send = Callable[[list[dict[str, Any]]], None]


class Ledger:
    """Which actions were delivered, as a table of ``(event, idx)`` on shared storage.

    Each batch is a partition of its own, so a batch that is repeated replaces
    what it wrote before.
    """

    def __init__(self, spark: SparkSession, path: str, event: str = "event_id"):
        self._spark, self._path, self._event = spark, path, event

    def delivered(self) -> DataFrame | None:
        """All that was delivered; None if nothing was."""
        jvm_path = self._spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path)
        if not jvm_path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path):
            return None
        return self._spark.read.parquet(self._path)

    def missing(self, actions: DataFrame, batch: int) -> DataFrame:
        """Actions that no other batch has delivered."""
        before = self.delivered()
        once = actions.dropDuplicates([self._event, "idx"])
        if before is None:
            return once
        others = before.where(F.col("batch") != batch).select(self._event, "idx")
        return once.join(others, [self._event, "idx"], "left_anti")

    def note(self, actions: DataFrame, batch: int) -> None:
        rows = actions.select(self._event, "idx")
        rows.write.mode("overwrite").parquet(f"{self._path}/batch={batch}")


def table_sink(ledger: Ledger, path: str) -> Callable[[DataFrame, int], None]:
    """Writes actions as Parquet, a folder for each batch; a repeated batch replaces its folder."""

    def write(actions: DataFrame, batch: int) -> None:
        fresh = ledger.missing(actions, batch)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")
        ledger.note(actions.sparkSession.read.parquet(f"{path}/batch={batch}"), batch)

    return write


def call_sink(ledger: Ledger, send: Send, size: int = 256) -> Callable[[DataFrame, int], None]:
    """Hands actions to ``send`` on the executors, ``size`` at a time, and notes them when all are sent.

    A batch that fails half-way is sent again as a whole: at least once.
    """

    def call(actions: DataFrame, batch: int) -> None:
        columns = actions.columns

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = frame.to_dict("records")
                for low in range(0, len(rows), size):
                    send(rows[low : low + size])
                yield frame[columns]

        sent = ledger.missing(actions, batch)
        ledger.note(sent.mapInPandas(run, sent.schema), batch)

    return call


def kafka_sink(ledger: Ledger, options: dict[str, str]) -> Callable[[DataFrame, int], None]:
    """Writes Kafka actions with Spark's own sink, which its package brings."""

    def write(actions: DataFrame, batch: int) -> None:
        fresh = ledger.missing(actions, batch)
        value = F.get_json_object("payload", "$.value")
        rows = fresh.select(F.get_json_object("payload", "$.key").alias("key"), value.alias("value"), F.col("target").alias("topic"))
        rows.write.format("kafka").options(**options).save()
        ledger.note(fresh, batch)

    return write


def upsert_sink(ledger: Ledger, spark: SparkSession, path: str, key: str = "target") -> Callable[[DataFrame, int], None]:
    """Keeps the last payload of each key in a table: versions ``v<batch>``, of which the last one counts."""

    def write(actions: DataFrame, batch: int) -> None:
        known = [int(n) for n in _versions(spark, path) if int(n) < batch]
        new = actions.groupBy(F.col(key).alias("key")).agg(F.max_by("payload", F.struct("event_id", "idx")).alias("value"))
        if known:
            old = spark.read.parquet(f"{path}/v{max(known)}")
            new = old.join(new.select("key"), "key", "left_anti").unionByName(new)
        new.write.mode("overwrite").parquet(f"{path}/v{batch}")
        ledger.note(actions, batch)

    return write


def _versions(spark: SparkSession, path: str) -> list[str]:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(jvm_path):
        return []
    return [s.getPath().getName()[1:] for s in fs.listStatus(jvm_path) if s.getPath().getName().startswith("v")]


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`upsert_sink` keeps."""
    return spark.read.parquet(f"{path}/v{max(map(int, _versions(spark, path)))}")
