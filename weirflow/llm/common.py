"""Session helpers shared by the operators: scratch tables, sizes, Arrow text buffers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts may be long, so few of them travel together.
BATCH_ROWS = 400
#: Bytes of text that the vectorised kernels take at once.
BLOCK_BYTES = 1 << 18

#: Seconds in which listeners let go of a plan that ran.
_SETTLE = 0.5

_roots: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches that carry whole texts to Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def scratch_root(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset, a local temporary
    folder stands in on a single machine (tests); on a cluster that is an error.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
            "spark.checkpoint.dir"
        )
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="weirflow-checkpoints-")
        root = f"{base.rstrip('/')}/weirflow-{uuid.uuid4().hex}"
        _roots[app] = root
        jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        atexit.register(lambda: _discard(fs, jvm_path))
    return _roots[app]


def _discard(fs, path) -> None:
    try:
        fs.delete(path, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone at exit
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """An unused path below :func:`scratch_root`."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Cuts the lineage with a table that survives lost executors, and lets Spark
    drop the shuffle files of what was computed before.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files that no plan refers to any more.

    It does so when the driver collects garbage, which may come late. Listeners
    hold a plan for a moment after it ran, hence the second turn.
    """
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(_SETTLE)


def trim(spark: SparkSession) -> None:
    """Have the driver's JVM give memory that it has freed back to the system.

    The collection shrinks a heap that a burst of plans has grown. What compiling
    and native code have freed stays with the C library until it is asked for it;
    a JVM without that command (before 17.0.9, or not on glibc) keeps it.
    """
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        # By the interface, as Java does not open the class that implements it.
        connection = jvm.java.lang.Class.forName("javax.management.MBeanServerConnection")
        invoke = next(m for m in connection.getMethods() if m.getName() == "invoke")
        asked = array(jvm.java.lang.Object, 4)
        asked[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        asked[1] = "systemTrimNativeHeap"
        asked[2], asked[3] = array(jvm.java.lang.Object, 0), array(jvm.java.lang.String, 0)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), asked)


class Growing:
    """One scratch table that rounds add rows to, one round at least, read once at the end.

    The plan that reads it is as small after many rounds as after one.
    """

    def __init__(self, spark: SparkSession, schema: str, name: str):
        self._spark, self._schema, self._path = spark, schema, scratch_path(spark, name)
        self._columns = [field.split()[0] for field in schema.split(", ")]

    def add(self, rows: DataFrame) -> None:
        rows.select(*self._columns).write.mode("append").option("compression", "zstd").parquet(self._path)

    def read(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self._path)


def fresh(columns: list[str], stem: str = "__") -> str:
    """A prefix that none of ``columns`` begins with, in either case."""
    while any(c.lower().startswith(stem) for c in columns):
        stem += "_"
    return stem


#: Groups of more than this part of all rows are dealt over several tasks.
_PART = 1000


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], salt: list[str], count: str = "n") -> DataFrame:
    """``rows`` joined with ``groups``, which holds a row per key and its number of rows.

    A key with more than a thousandth of all rows gets several slots: its row of
    ``groups`` is repeated for each, and ``rows`` choose one by a hash of
    ``salt``. There are fewer than a thousand such keys, whatever the size, so
    the list of them is broadcast. ``groups`` is read three times: materialise it.
    """
    total = groups.agg(F.sum(count)).first()[0] or 0
    part = max(total // _PART, 64)
    hot = groups.where(F.col(count) > part).select(*keys, F.ceil(F.col(count) / part).cast("int").alias("__slots"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "__slot", F.coalesce(F.expr(f"pmod(xxhash64({', '.join(salt)}), __slots)").cast("int"), F.lit(0))
    )
    every = F.sequence(F.lit(0), F.greatest(F.ceil(F.col(count) / part).cast("int"), F.lit(1)) - 1)
    slots = F.when(F.col(count) > part, every).otherwise(F.array(F.lit(0)))
    return dealt.drop("__slots").join(groups.withColumn("__slot", F.explode(slots)), [*keys, "__slot"]).drop("__slot")


def forget(df: DataFrame) -> None:
    """Delete a scratch table that :func:`materialise` wrote and nothing needs any more."""
    spark = df.sparkSession
    root = scratch_root(spark)
    for file in df.inputFiles()[:1]:
        folder = file.rsplit("/", 1)[0]
        if root.rsplit("/", 1)[-1] in folder:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lean(stage):
    """An Arrow generator that gives freed memory back to the system when a task ends.

    Spark keeps idle Python workers; without this each would hold its peak.
    """

    @functools.wraps(stage)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from stage(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[
        column.offset : column.offset + len(column) + 1
    ].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def spans(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes together, or one longer row."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high
