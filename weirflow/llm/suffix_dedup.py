"""Suffix-array dedup: bytes covered by a long string that starts earlier are removed.

The segments of a shard are sorted by external induced sorting
(:mod:`weirflow.llm.induced`); suffixes whose common prefix reaches the window
are equal windows, of which the earliest stays. :mod:`weirflow.llm.repeats`
brings equal windows into one shard, and settles by itself what needs no sort:
segments that are equal as a whole, and leaders with too many segments for one
task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import repeats
from weirflow.llm.anchors import Unit, unpack
from weirflow.llm.common import lean, text_buffer
from weirflow.llm.induced import MEMORY, induce

#: Bytes of a string that may not repeat.
WINDOW = 100
_GRAM = 20
#: Different segments of one leader that are sorted together at most.
CROWD = 1024


def repeated_windows(
    text: np.ndarray,
    whole: np.ndarray,
    segment: np.ndarray,
    docs: np.ndarray,
    shift: np.ndarray,
    window: int,
    memory: int = MEMORY,
) -> np.ndarray:
    """Places of ``text`` whose window also stands at an earlier place.

    Args:
        text: symbols; the last one is the only 0.
        whole: places where a window begins (not over a segment's end).
        segment: each place's segment.
        docs, shift: each segment's document, and how far a place in it lies behind its place in ``text``;
            document and place there order the places.
    """
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    last = np.zeros(0, np.int64)
    chains = 0

    def emit(place: np.ndarray, prefix: np.ndarray, falling: bool) -> None:
        nonlocal last, chains
        same = prefix >= window
        chain = np.cumsum(~same) + chains
        if len(last) and same[0] and whole[last[0]]:
            blocks.append((last, np.full(1, chains)))  # may stand there already, as the same place
        chains = int(chain[-1])
        member = same.copy()
        member[:-1] |= same[1:]
        member &= whole[place]
        blocks.append((place[member], chain[member]))
        last = place[-1:].copy()

    induce(text, window, emit, memory)
    place = np.concatenate([b[0] for b in blocks])
    chain = np.concatenate([b[1] for b in blocks])
    of = segment[place]
    order = np.lexsort((place + shift[of], docs[of], chain))
    place, chain = place[order], chain[order]
    later = (chain[1:] == chain[:-1]) & (place[1:] != place[:-1])
    return place[1:][later]


def _joined_text(
    data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray]:
    """Segments as symbols from 2 on, each with a 1 behind and a 0 at the end, and where whole windows begin.

    The symbols are the bytes that occur, numbered: 8 bits hold them unless nearly all 256 occur.
    """
    occurs = np.bincount(data, minlength=256) > 0
    number = np.cumsum(occurs) + 1
    number = number.astype(np.uint8 if number[-1] < 256 else np.uint16)
    text = np.zeros(len(data) + len(starts) + 1, number.dtype)
    ends = starts + sizes
    inner = np.ones(len(text), bool)
    inner[ends] = inner[-1] = False
    text[inner] = number[data]
    text[ends] = 1
    steps = np.zeros(len(text), np.int8)
    has = sizes >= window
    steps[starts[has]] = 1
    steps[ends[has] - window + 1] -= 1
    return text, np.cumsum(steps, dtype=np.int8).astype(bool)


def _resolver(window: int, memory: int):
    @lean
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [repeats.shard_rows(b) for b in batches if b.num_rows]
        if not rows:
            return
        leads, contents, docs, places = (np.concatenate([r[i] for r in rows]) for i in range(4))
        column = pa.chunked_array([r[4] for r in rows]).combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
        offsets = np.frombuffer(column.buffers()[1], np.int32)[
            column.offset : column.offset + len(column) + 1
        ].astype(np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        starts = offsets[:-1] + np.arange(n)
        text, whole = _joined_text(data, starts, sizes, window)
        segment = np.repeat(np.arange(n, dtype=np.int32), sizes + 1)
        segment = np.append(segment, np.int32(n - 1))
        later = repeated_windows(text, whole, segment, docs, unpack(places)[0] - starts, window, memory)
        later = np.sort(later)
        if not len(later):
            return
        which = segment[later]
        low = np.concatenate([[True], (later[1:] != later[:-1] + 1) | (which[1:] != which[:-1])])
        heads = np.flatnonzero(low)
        tails = np.append(heads[1:], len(later)) - 1
        which = which[heads]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(leads[which]),
                pa.array(contents[which]),
                pa.array((later[heads] - starts[which]).astype(np.int32)),
                pa.array((later[tails] - starts[which] + 1).astype(np.int32)),
            ],
            ["lead", "content", "low", "high"],
        )

    return resolve


def _merged(ranges: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the maximal ranges of each row; touching ranges become one."""
    flat = ranges.flatten()
    counts = ranges.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(counts)), counts)
    start, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
    order = np.lexsort((start, row))
    row = row[order]
    shift = row * (int(end.max()) + 1 if len(end) else 1)  # every row's ranges behind those of the row before
    start, reach = start[order] + shift, np.maximum.accumulate(end[order] + shift)
    head = np.ones(len(row), bool)
    head[1:] = (start[1:] > reach[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(head)
    tail = np.append(head[1:], len(row))[: len(head)] - 1
    return row[head], start[head] - shift[head], reach[tail] - shift[tail]


@lean
def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        row, start, end = _merged(batch.column("ranges"))
        size = np.diff(offsets)[row]  # a repeated row of a document may have a shorter text
        low, high = np.minimum(start, size), np.minimum(end, size)
        cuts = np.concatenate([[0], np.stack([low, high], 1).ravel() + offsets[np.repeat(row, 2)], [len(data)]])
        view = memoryview(np.ascontiguousarray(data))
        kept = b"".join(view[a:b] for a, b in cuts.reshape(-1, 2).tolist())
        first = np.searchsorted(row, np.arange(len(offsets)))  # of each row's ranges
        removed = np.concatenate([[0], np.cumsum(high - low)])[first]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(np.diff(offsets)),
                pa.ListArray.from_arrays(
                    pa.array(first.astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"]),
                ),
                pa.Array.from_buffers(
                    pa.binary(),
                    batch.num_rows,
                    [None, pa.py_buffer((offsets - removed).astype(np.int32)), pa.py_buffer(kept)],
                ),
            ],
            ["doc_id", "n_bytes", "removed", "kept"],
        )


def merge(ranges) -> list[tuple[int, int]]:
    """Maximal ranges that cover the given ones; touching ranges become one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            if end > out[-1][1]:
                out[-1] = (out[-1][0], end)
        else:
            out.append((start, end))
    return out


def remove_repeated_bytes(
    docs: DataFrame, window: int = WINDOW, memory: int = MEMORY, crowd: int = CROWD
) -> DataFrame:
    """Remove each byte covered by a ``window``-byte string that also starts earlier.

    Earlier means in a smaller doc_id, or in the same document before. Strings
    never cross documents and are judged on the input.

    Returns ``doc_id, n_bytes, removed array<struct<start,end>>, kept binary`` for
    each row. A null text is empty. A row without a doc_id keeps its text and is
    no copy's original. Repeated rows of a document count as that one document
    and are each returned. Other columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = repeats.covered(base, Unit("bytes", window, _GRAM, crowd), _resolver(window, memory))
    return base.join(ranges.hint("shuffle_hash"), "doc_id", "left").mapInArrow(
        _strip,
        "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.expr("aggregate(removed, 0L, (n, x) -> n + x.end - x.start)").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
