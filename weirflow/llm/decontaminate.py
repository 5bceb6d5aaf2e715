"""Benchmark decontamination by winnowing.

Of each 13-word window the smallest 5-gram hash is kept as its fingerprint, on
both sides, so every shared run of 13 words shares a fingerprint. Fingerprints
of the documents are joined with those of the benchmark items; hits are extended
to whole windows and compared word by word. Items of fewer than 13 words have no
full window: their whole word run is looked up at every place.

A benchmark of at most ``limit`` bytes, counted first, is indexed in each
executor. A larger one is joined by fingerprint instead, and each document is
verified against the items it met.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm.anchors import Unit, _pieces
from weirflow.llm.common import fresh, lean, prepare, text_buffer
from weirflow.llm.tokens import ALNUM_LOWER, grams, row_ends, words

#: Words of a window, and of the grams that fingerprints hash.
WINDOW, _GRAM = 13, 5
#: Bytes of benchmark text up to which every executor gets the whole index.
INDEX_BYTES = 32 << 20

_OUT = {
    "n_words": "long",
    "n_hit": "long",
    "items": "array<string>",
    "spans": "array<struct<start:long,end:long>>",
    "cleaned": "string",
}
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _led(hashes: np.ndarray, first: np.ndarray):
    """Windows by fingerprint: ``(first window, last window, fingerprint)`` of a block of rows."""
    n = len(hashes)
    zero = np.zeros(n, np.int64)
    unit = Unit("words", WINDOW, _GRAM)
    return list(_pieces(grams(hashes, _GRAM), row_ends(first), zero, zero, n, unit))


class Index:
    """Fingerprints and windows of benchmark items."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names = [name for name, _ in items]
        data, offsets = text_buffer(pa.array([text for _, text in items], pa.string()))
        prints: list[np.ndarray] = []
        found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self._words: list[np.ndarray] = []
        at = 0
        for low, high, hashes, _, _, first in words(data, offsets, ALNUM_LOWER):
            prints += [r.hash for r in _led(hashes, first)]
            for i in range(low, high):
                begin, end = int(first[i - low]), int(first[i - low + 1])
                length = min(WINDOW, end - begin)
                if length:
                    g = grams(hashes[begin:end], length)
                    found.setdefault(length, []).append(
                        (g, np.full(len(g), i), at + begin + np.arange(len(g)))
                    )
            self._words.append(hashes)
            at += len(hashes)
        self._words = np.concatenate(self._words) if self._words else np.zeros(0, np.uint64)
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.windows: dict[int, tuple[np.ndarray, ...]] = {}
        for length, parts in found.items():
            g, item, place = (np.concatenate([p[k] for p in parts]) for k in range(3))
            order = np.argsort(g, kind="stable")
            self.windows[length] = g[order], item[order], place[order]

    def match(self, hashes: np.ndarray, starts: np.ndarray, length: int):
        """Pairs (start, item) of windows of ``hashes`` that are windows of items."""
        if not len(starts):
            return starts, starts
        g, item, place = self.windows[length]
        wanted = np.stack([hashes[starts + j] for j in range(length)], axis=1)
        key = _gram_rows(wanted)
        low, high = np.searchsorted(g, key, "left"), np.searchsorted(g, key, "right")
        hit = np.flatnonzero(high > low)
        sizes = (high - low)[hit]
        which = np.repeat(hit, sizes)
        entry = np.repeat(low[hit] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        theirs = np.stack([self._words[place[entry] + j] for j in range(length)], axis=1)
        equal = (theirs == wanted[which]).all(axis=1) if len(which) else np.zeros(0, bool)
        return starts[which[equal]], item[entry[equal]]


def _gram_rows(rows: np.ndarray) -> np.ndarray:
    """:func:`grams` of each row of a matrix."""
    return grams(rows.reshape(-1), rows.shape[1])[:: rows.shape[1]]


def _isin(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return sorted_values[at] == x


def _hits(index: Index, hashes: np.ndarray, first: np.ndarray):
    """Starts, lengths and items of all item windows in a block of rows."""
    out = []
    if WINDOW in index.windows:
        for r in _led(hashes, first):
            hit = _isin(index.prints, r.hash)
            low, sizes = r.first[hit], (r.last - r.first + 1)[hit]
            starts = np.repeat(low - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            out.append((*index.match(hashes, starts, WINDOW), WINDOW))
    ends = row_ends(first)
    for length in sorted(set(index.windows) - {WINDOW}):
        g = grams(hashes, length)
        starts = np.flatnonzero(
            _isin(index.windows[length][0], g) & (ends[: len(g)] >= np.arange(len(g)) + length)
        )
        out.append((*index.match(hashes, starts, length), length))
    return out


def _row_spans(hit: np.ndarray) -> list[dict]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]


def _judge(data, offsets, index_of) -> Iterator[tuple]:
    """The new columns of each row; ``index_of(low, high)`` gives the indexes of row blocks."""
    for low, high, hashes, begins, stops, first in words(data, offsets, ALNUM_LOWER):
        for block_low, block_high, index in index_of(low, high):
            a, b = first[block_low - low], first[block_high - low]
            h, f = hashes[a:b], first[block_low - low : block_high - low + 1] - a
            steps = np.zeros(len(h) + 1, np.int64)
            pairs: set[tuple[int, int]] = set()
            for starts, items, length in _hits(index, h, f) if index else ():
                np.add.at(steps, starts, 1)
                np.add.at(steps, starts + length, -1)
                rows = np.searchsorted(f, starts, side="right") - 1
                pairs.update(zip(rows.tolist(), items.tolist(), strict=True))
            hit = np.cumsum(steps[:-1]) > 0
            total = np.concatenate([[0], np.cumsum(hit)])
            names: dict[int, set[str]] = {}
            for row, item in pairs:
                names.setdefault(row, set()).add(index.names[item])
            for i in range(block_high - block_low):
                n_hit = int(total[f[i + 1]] - total[f[i]])
                spans = _row_spans(hit[f[i] : f[i + 1]]) if n_hit else []
                cleaned = None
                if n_hit:
                    row = block_low + i
                    at, pieces = int(offsets[row]), []
                    for span in spans:
                        pieces.append(data[at : begins[a + f[i] + span["start"]]].tobytes())
                        at = int(stops[a + f[i] + span["end"] - 1])
                    pieces.append(data[at : offsets[row + 1]].tobytes())
                    cleaned = b"".join(pieces).decode()
                yield int(f[i + 1] - f[i]), n_hit, sorted(names.get(i, ())), spans, cleaned


def _batch(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_OUT)
    types = [pa.int64(), pa.int64(), pa.list_(pa.string()), _SPANS, pa.string()]
    carried = [c for c in batch.schema.names if c not in ("text", "met")]
    return pa.RecordBatch.from_arrays(
        [
            *(batch.column(c) for c in carried),
            *(pa.array(c, t) for c, t in zip(columns, types, strict=True)),
        ],
        [*carried, *_OUT],
    )


def _with_whole_index(broadcast):
    @lean
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = broadcast.value
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            rows = _judge(data, offsets, lambda low, high: [(low, high, index)])
            yield _batch(batch, list(rows))

    return scan


@lean
def _with_own_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        items = batch.column("met").to_pylist()

        def each(low: int, high: int, items=items):
            for i in range(low, high):
                own = [(x["item_id"], x["item_text"]) for x in items[i] or ()]
                yield i, i + 1, Index(own) if own else None

        yield _batch(batch, list(_judge(data, offsets, each)))


def _fingerprints(key: str, lengths: tuple[int, ...], whole: bool):
    """Rows ``(key, print)``; runs of ``lengths`` words at every place, or of whole short rows."""

    @lean
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            keys = batch.column(key)
            for low, _, hashes, _, _, first in words(data, offsets, ALNUM_LOWER):
                ends, sizes = row_ends(first), np.diff(first)
                row_of = np.repeat(np.arange(len(sizes)), sizes)
                rows, prints = [], []
                for r in _led(hashes, first):
                    rows.append(row_of[r.first])
                    prints.append(r.hash)
                for length in lengths:
                    g = grams(hashes, length)
                    fits = ends[: len(g)] >= np.arange(len(g)) + length
                    if whole:
                        fits &= sizes[row_of[: len(g)]] == length
                    rows.append(row_of[: len(g)][fits])
                    prints.append(g[fits] + np.uint64(length))
                pairs = np.unique(
                    np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(prints)]), axis=1
                ) if rows else np.zeros((2, 0), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(pairs[0].astype(np.int64) + low)), pa.array(pairs[1].view(np.int64))],
                    [key, "print"],
                )

    return emit


@lean
def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        for _, _, _, _, _, first in words(data, offsets, ALNUM_LOWER):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(first))], ["n"])


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, limit: int = INDEX_BYTES, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Benchmark windows in documents.

    Args:
        docs: ``doc_id`` and ``text``; of the other columns those in ``carry`` are passed on,
            which may not be named as what is returned.
        benchmark: ``item_id`` and ``text``; rows without an id or words match
            nothing, repeated rows count once.

    Returns ``doc_id, n_words, n_hit, items array<string>`` (sorted), ``spans`` (hit
    word ranges) and ``cleaned`` (the text without them; null if there are none)
    for each row of ``docs``. A null text has no words.
    """
    spark = prepare(docs.sparkSession)
    if clash := {"doc_id", "text", *_OUT} & {c.lower() for c in carry}:
        raise ValueError(f"columns {', '.join(sorted(clash))} cannot be carried under these names")
    docs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry
    )
    kept = {f.name: f.dataType.simpleString() for f in docs.schema if f.name != "text"}
    out = ", ".join(f"`{name}` {kind}" for name, kind in (kept | _OUT).items())
    items = (
        benchmark.where("item_id is not null and text is not null")
        .select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
        .distinct()
    )
    size = items.agg(F.sum(F.octet_length("text") + F.octet_length("item_id"))).first()[0] or 0
    if size <= limit:
        index = Index([tuple(r) for r in items.collect()])
        return docs.mapInArrow(_with_whole_index(spark.sparkContext.broadcast(index)), out)
    counts = items.select("text").mapInArrow(_word_counts, "n long").where(f"n between 1 and {WINDOW - 1}")
    lengths = tuple(sorted(r[0] for r in counts.distinct().collect()))
    # Rows without an id are known by their text; a clash only adds items to look for.
    row = f"{fresh(docs.columns)}row"
    keyed = docs.withColumn(row, F.coalesce("doc_id", F.xxhash64("text")))
    ours = keyed.select(row, "text").mapInArrow(_fingerprints(row, lengths, False), f"`{row}` long, print long")
    theirs = items.mapInArrow(_fingerprints("item_id", lengths, True), "item_id string, print long")
    met = (
        ours.join(theirs, "print")
        .select(row, "item_id")
        .distinct()
        .join(items.withColumnRenamed("text", "item_text"), "item_id")
        .groupBy(row)
        .agg(F.collect_set(F.struct("item_id", "item_text")).alias("met"))
    )
    return keyed.join(met, row, "left").drop(row).mapInArrow(_with_own_items, out)


#: A document is contaminated if hits are a twentieth of its words or more.
CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )
