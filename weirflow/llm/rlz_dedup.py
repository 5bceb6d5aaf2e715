"""Substring dedup of word runs by relative Lempel-Ziv parsing.

The segments around one leader (:mod:`weirflow.llm.repeats`) are the indexed
reference of that leader, in the order of the documents. Each segment is parsed
greedily against all earlier ones: the longest match at a place becomes a
factor. Windows inside a factor of at least ``window`` words start earlier too;
windows across a factor boundary, which may stand elsewhere in the reference,
are looked up one by one.
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
from weirflow.llm.suffix_dedup import merge
from weirflow.llm.tokens import SPACED, words

#: Words of a passage that may not repeat.
WINDOW = 20
_GRAM = 6
_SYMBOL = 8
#: Different segments of one leader that are one reference at most.
CROWD = 256


class Reference:
    """Text of word symbols with an index of its ``gram``-word runs."""

    def __init__(self, gram: int):
        self._gram = gram * _SYMBOL
        self._texts: list[bytes] = []
        self._index: dict[bytes, list[tuple[int, int]]] = {}

    def add(self, text: bytes) -> None:
        number = len(self._texts)
        self._texts.append(text)
        for at in range(0, len(text) - self._gram + 1, _SYMBOL):
            self._index.setdefault(text[at : at + self._gram], []).append((number, at))

    def longest(self, text: bytes, at: int) -> int:
        """Bytes of the longest match of ``text`` from ``at``; 0 below ``gram`` words."""
        best = 0
        for number, place in self._index.get(text[at : at + self._gram], ()):
            other = self._texts[number]
            limit = min(len(text) - at, len(other) - place)
            if limit <= best or text[at : at + best + _SYMBOL] != other[place : place + best + _SYMBOL]:
                continue
            low, high = best + _SYMBOL, limit
            while low < high:  # halving on whole symbols
                middle = (low + high + _SYMBOL) // (2 * _SYMBOL) * _SYMBOL
                if text[at + low : at + middle] == other[place + low : place + middle]:
                    low = middle
                else:
                    high = middle - _SYMBOL
            best = max(best, low)
        return best

    def holds(self, text: bytes, at: int, size: int) -> bool:
        wanted = text[at : at + size]
        for number, place in self._index.get(text[at : at + self._gram], ()):
            if self._texts[number].startswith(wanted, place):
                return True
        return False


def repeated_windows(text: bytes, reference: Reference, window: int) -> list[int]:
    """Window starts (in words) of ``text`` whose words also stand in ``reference``."""
    size = window * _SYMBOL
    last = len(text) - size
    inside: set[int] = set()
    boundaries: list[int] = []
    at = 0
    while at < len(text):
        length = reference.longest(text, at) or _SYMBOL
        inside.update(range(at, at + length - size + 1, _SYMBOL))
        at += length
        boundaries.append(at)
    for boundary in boundaries:
        for start in range(max(boundary - size + _SYMBOL, 0), min(boundary - _SYMBOL, last) + 1, _SYMBOL):
            if start not in inside and reference.holds(text, start, size):
                inside.add(start)
    return sorted(start // _SYMBOL for start in inside)


def _resolver(window: int, gram: int):
    @lean
    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [repeats.shard_rows(b) for b in batches if b.num_rows]
        if not rows:
            return
        leads, contents, docs, places = (np.concatenate([r[i] for r in rows]) for i in range(4))
        symbols: list[bytes] = []
        for row in rows:
            data, offsets = text_buffer(row[4].cast(pa.string()))
            for low, high, hashes, _, _, first in words(data, offsets, SPACED):
                raw, bounds = hashes.tobytes(), (first * _SYMBOL).tolist()
                symbols += [raw[bounds[i] : bounds[i + 1]] for i in range(high - low)]
        at = unpack(places)[2]
        out: list[list[int]] = [[], [], [], []]
        reference, current = Reference(gram), None
        for i in np.lexsort((at, docs, leads)).tolist():
            if leads[i] != current:
                reference, current = Reference(gram), leads[i]
            else:
                for low, high in merge((w, w + 1) for w in repeated_windows(symbols[i], reference, window)):
                    for column, x in zip(out, (leads[i], contents[i], low, high), strict=True):
                        column.append(int(x))
            reference.add(symbols[i])
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in out[:2]), *(pa.array(x, pa.int32()) for x in out[2:])],
                ["lead", "content", "low", "high"],
            )

    return resolve


@lean
def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        ranges = batch.column("ranges").to_pylist()
        raw = data.tobytes()
        counts, kept, spans = [], [], []
        for low, high, hashes, starts, ends, first in words(data, offsets, SPACED):
            for i in range(low, high):
                n = int(first[i - low + 1] - first[i - low])
                merged = merge((r["start"], r["end"]) for r in ranges[i] or ())
                every = raw[offsets[i] : offsets[i + 1]].split()
                pieces, at = [], 0
                for start, end in merged:
                    pieces += every[at:start]
                    at = end
                pieces += every[at:]
                counts.append(n)
                kept.append(b" ".join(pieces).decode())
                spans.append([{"start": s, "end": e} for s, e in merged])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, span), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "removed", "kept"],
        )


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """Remove each word covered by a ``window``-word run that also starts earlier.

    Words stand between white space and are compared unchanged. Earlier means in
    a smaller doc_id, or in the same document before; runs never cross documents
    and are judged on the input.

    Returns ``doc_id, n_words, removed array<struct<start,end>>`` (in words) and
    ``kept`` (words joined by one space) for each row. A null text has no words.
    A row without a doc_id keeps its words and is no copy's original. Repeated
    rows of a document count as that one document and are each returned. Other
    columns are ignored.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = repeats.covered(base, Unit("words", window, _GRAM, crowd), _resolver(window, _GRAM))
    return base.join(ranges.hint("shuffle_hash"), "doc_id", "left").mapInArrow(
        _strip,
        "doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(removed, 0L, (n, x) -> n + x.end - x.start)").alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
