"""Exact repeated windows across a corpus, shared by byte and word repeat removal.

1. Leaders (``anchors``) are counted; those that occur once are dropped.
2. The segments around repeated leaders are read from the texts once. Equal
   segments collapse to their first occurrence; all windows of the later ones
   have started before.
3. Leaders with several different segments need the windows themselves
   compared: a *resolver* does that shard by shard. A leader with more than
   ``Unit.crowd`` segments is never brought together: whole blocks of its windows,
   and single ones where blocks differ in part, are named by 128-bit hash and
   given to the earliest segment that holds them.
4. The covered ranges of each document are gathered and handed to the texts.

Occurrences of one segment, which may be a large part of all, are dealt over
several tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.anchors import Prefix, Runs, Unit, pack, runs, unpack
from weirflow.llm.common import forget, lean, materialise, prepare, release, spans, spread_join, text_buffer
from weirflow.llm.tokens import SPACED, mix, words

#: Bytes of segments that make a shard of the resolver.
SHARD_BYTES = 3 << 20
#: Segments that a task remembers to have written.
_WRITTEN = 400_000
#: Rows of an Arrow batch of places, with the last block's beyond.
_PLACES = 8192

Resolver = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _leaders(unit: Unit):
    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            found = [r.hash for r in runs(data, offsets, unit)]
            if found:
                values, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(values)), pa.array(np.minimum(n, 2).astype(np.int8))],
                    ["lead", "n"],
                )

    return count


def _gathered(blocks: Iterator[Runs]) -> Iterator[list[Runs]]:
    """Blocks of runs in lists of ``_PLACES`` runs or more."""
    found: list[Runs] = []
    for r in blocks:
        found.append(r)
        if sum(len(x.hash) for x in found) >= _PLACES:
            yield found
            found = []
    if found:
        yield found


def _places(unit: Unit):
    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = text_buffer(batch.column("text"))
            for found in _gathered(runs(data, offsets, unit)):
                lead, doc_id, place = (
                    np.concatenate(x) for x in zip(*((r.hash, ids[r.row], pack(r)) for r in found), strict=True)
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(lead)), pa.array(doc_id), pa.array(place)],
                    ["lead", "doc_id", "place"],
                )

    return place


def _blocks(unit: Unit, data: np.ndarray, offsets: np.ndarray):
    """Blocks of rows: ``(low, high, symbols, first symbol of each row, cut)``.

    ``cut(a, b)`` gives the bytes of a range of the block's symbols.
    """
    if unit.kind == "bytes":
        for low, high in spans(offsets):
            block = data[offsets[low] : offsets[high]]
            yield low, high, block, offsets[low:high] - offsets[low], lambda a, b, x=block: x[a:b].tobytes()
    else:
        for low, high, hashes, starts, ends, first in words(data, offsets, SPACED):
            yield (
                low,
                high,
                hashes,
                first[:-1],
                lambda a, b, s=starts, e=ends: b" ".join(data[s[a] : e[b - 1]].tobytes().split()),
            )


def _segments(unit: Unit):
    @lean
    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        written: set[int] = set()  # a task writes the bytes of equal segments once
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            lists = batch.column("anchors")
            flat = lists.flatten()
            leads = flat.field("lead").to_numpy(zero_copy_only=False)
            places = flat.field("place").to_numpy(zero_copy_only=False)
            counts = lists.value_lengths().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(counts)])
            rows = np.repeat(np.arange(len(counts)), counts)
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for low, high, symbols, base, cut in _blocks(unit, data, offsets):
                here = slice(int(bounds[low]), int(bounds[high]))
                if here.start == here.stop:
                    continue
                first, last, lead = unpack(places[here])
                begin = first + base[rows[here] - low]
                end = begin + (last - first) + unit.window
                content = Prefix(symbols).hash(begin, end) + (lead - first).astype(np.uint64)
                if len(written) > _WRITTEN:
                    written.clear()
                texts: list[bytes | None] = []
                keys = (content ^ leads[here].view(np.uint64)).tolist()
                for key, a, b in zip(keys, begin.tolist(), end.tolist(), strict=True):
                    if key in written:
                        texts.append(None)
                    else:
                        written.add(key)
                        texts.append(cut(a, b))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(leads[here]),
                        pa.array(_signed(content)),
                        pa.array(ids[rows[here]]),
                        pa.array(places[here]),
                        pa.array(texts, pa.binary()),
                    ],
                    ["lead", "content", "doc_id", "place", "bytes"],
                )

    return cut_out


def _two_hashes(symbols: np.ndarray) -> tuple[Prefix, Prefix]:
    return Prefix(symbols), Prefix(symbols ^ symbols.dtype.type(0x5A))


def _crowd_rows(unit: Unit, batch: pa.RecordBatch):
    """Each row's symbols, and its first and last window and leader, from the segment's start."""
    first, last, lead = unpack(batch.column("place").to_numpy(zero_copy_only=False))
    for i, raw in enumerate(batch.column("bytes").to_pylist()):
        data = np.frombuffer(raw, np.uint8)
        if unit.kind == "words":
            data = next(words(data, np.array([0, len(data)]), SPACED))[2]
        yield i, data, int(last[i] - first[i]), int(lead[i] - first[i]), int(first[i])


def _block_size(unit: Unit) -> int:
    return max(2, unit.window // 6)


def _spans(unit: Unit):
    """The blocks of windows of each row by 128-bit hash: ``s1, s2`` of all their symbols, ``c1, c2`` of their core.

    Blocks count windows by their distance from the leader, so equal windows lie
    in equal blocks. The core is what all windows of a block share.
    """
    size = _block_size(unit)

    @lean
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(6)]
            for i, symbols, last, lead, _ in _crowd_rows(unit, batch):
                block = np.arange(-lead // size, (last - lead) // size + 1)
                low = np.maximum(block * size + lead, 0)
                high = np.minimum((block + 1) * size - 1 + lead, last)
                core = (block + 1) * size - 1 + lead, block * size + unit.window + lead
                shape = ((low - block * size - lead) * 256 + (high - low)).astype(np.uint64)
                one, two = _two_hashes(symbols)
                for column, x in zip(
                    out,
                    (
                        np.full(len(block), i),
                        block,
                        *(mix(h.hash(low, high + unit.window) + shape) for h in (one, two)),
                        *(h.hash(*core) for h in (one, two)),
                    ),
                    strict=True,
                ):
                    column.append(x)
            if out[0]:
                row, block, *hashes = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(row)) for c in ("lead", "content", "doc_id", "place")),
                        pa.array(block.astype(np.int32)),
                        *(pa.array(_signed(h)) for h in hashes),
                    ],
                    ["lead", "content", "doc_id", "place", "block", "s1", "s2", "c1", "c2"],
                )

    return split


def _windows(unit: Unit):
    """The windows in a row's ``mixed`` blocks by 128-bit hash."""
    size = _block_size(unit)

    @lean
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            blocks = batch.column("mixed").to_pylist()
            for i, symbols, last, lead, _ in _crowd_rows(unit, batch):
                at = np.arange(last + 1)
                at = at[np.isin((at - lead) // size, blocks[i])]
                one, two = _two_hashes(symbols)
                for column, x in zip(
                    out,
                    (np.full(len(at), i), *(h.hash(at, at + unit.window) for h in (one, two)), at - lead),
                    strict=True,
                ):
                    column.append(x)
            if out[0]:
                row, one, two, from_lead = (np.concatenate(x) for x in out)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(row)) for c in ("lead", "content", "doc_id", "place")),
                        pa.array(_signed(one)),
                        pa.array(_signed(two)),
                        pa.array(from_lead.astype(np.int32)),
                    ],
                    ["lead", "content", "doc_id", "place", "w1", "w2", "from_lead"],
                )

    return split


#: Where a segment's leader stands in its document.
_LEAD_AT = "shiftright(place, 16) + (place & 255)"


def _crowded(crowd: DataFrame, unit: Unit) -> DataFrame:
    """``(lead, content, inner)``: runs of later windows of segments whose leaders have too many.

    A whole block counts as one where its span is another segment's too: the
    earliest segment owns it, for the others all its windows are later. Only
    blocks that share their core with another span need their windows, once for
    each span; the earliest segment owns a window. What a segment does not own,
    or owns in a block that is not mixed, follows without a row for each window.
    """
    size = _block_size(unit)
    earliest = F.min(F.struct("doc_id", F.expr(_LEAD_AT).alias("at"), "content")).alias("first")
    spans = crowd.mapInArrow(
        _spans(unit),
        "lead long, content long, doc_id long, place long, block int, s1 long, s2 long, c1 long, c2 long",
    )
    owned = materialise(
        spans.groupBy("lead", "block", "c1", "c2", "s1", "s2").agg(earliest).drop("s1", "s2"), "owned"
    )
    core = ["lead", "block", "c1", "c2"]
    cores = materialise(owned.groupBy(*core).agg(F.count("*").alias("n")), "cores")
    own = materialise(
        spread_join(owned, cores, core, ["first"])
        .select("lead", "first.content", "block", (F.col("n") > 1).alias("mixed"))
        .groupBy("lead", "content")
        .agg(
            F.collect_set("block").alias("own"),
            F.collect_set(F.when(F.col("mixed"), F.col("block"))).alias("mixed"),
        ),
        "own",
    )
    windows = crowd.join(own.where("size(mixed) > 0"), ["lead", "content"]).mapInArrow(
        _windows(unit), "lead long, content long, doc_id long, place long, w1 long, w2 long, from_lead int"
    )
    firsts = (
        windows.groupBy("lead", "from_lead", "w1", "w2")
        .agg(earliest)
        .groupBy("lead", "first.content")
        .agg(F.collect_set("from_lead").alias("firsts"))
    )
    none = F.expr("cast(array() as array<int>)")
    marked = (
        crowd.select("lead", "content", "place")
        .join(own, ["lead", "content"], "left")
        .join(firsts, ["lead", "content"], "left")
        .withColumns({c: F.coalesce(c, none) for c in ("own", "mixed", "firsts")})
    )
    from_lead = "(x - cast(place & 255 as int))"
    block = f"cast(floor({from_lead} / {size}) as int)"
    later = (
        f"filter(sequence(0, cast(shiftright(place, 8) & 255 as int)), x -> not array_contains(own, {block})"
        f" or (array_contains(mixed, {block}) and not array_contains(firsts, {from_lead})))"
    )
    starts = "filter(later, x -> not array_contains(later, x - 1))"
    ends = "filter(later, x -> not array_contains(later, x + 1))"
    return (
        marked.withColumn("later", F.expr(later))
        .where("size(later) > 0")
        .selectExpr(
            "lead", "content", f"zip_with({starts}, {ends}, (x, y) -> struct(x as low, y + 1 as high)) as inner"
        )
    )


def shard_rows(batch: pa.RecordBatch):
    """Rows of a resolver's input as ``(lead, content, doc, place, bytes)`` columns."""
    return (
        batch.column("lead").to_numpy(zero_copy_only=False),
        batch.column("content").to_numpy(zero_copy_only=False),
        batch.column("doc_id").to_numpy(zero_copy_only=False),
        batch.column("place").to_numpy(zero_copy_only=False),
        batch.column("bytes"),
    )


def covered(docs: DataFrame, unit: Unit, resolver: Resolver) -> DataFrame:
    """``(doc_id, ranges)``: symbol ranges of windows that also start earlier.

    Args:
        docs: rows with ``doc_id`` and ``text``; a null text is empty, rows
            without a doc_id take no part, repeated rows of a document count once.
        resolver: ``mapInArrow`` function over a shard of segments (lead, content,
            doc_id, place, bytes) that yields ``(lead, content, low, high)``:
            windows ``low`` to ``high - 1`` of that segment start earlier in
            another one of the same leader.
    """
    spark = prepare(docs.sparkSession)
    texts = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long"), "text"
    )
    repeated = materialise(
        texts.select("text")
        .mapInArrow(_leaders(unit), "lead long, n byte")
        .groupBy("lead")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .select("lead"),
        "leads",
    )
    places = texts.mapInArrow(_places(unit), "lead long, doc_id long, place long")
    anchors = materialise(
        places.join(repeated.hint("shuffle_hash"), "lead").select("lead", "doc_id", "place"), "anchors"
    )
    release(spark)
    lists = anchors.groupBy("doc_id").agg(F.collect_set(F.struct("lead", "place")).alias("anchors"))
    segments = materialise(
        texts.join(lists.hint("shuffle_hash"), "doc_id").mapInArrow(
            _segments(unit), "lead long, content long, doc_id long, place long, bytes binary"
        ),
        "segments",
    )
    forget(anchors)
    forget(repeated)
    release(spark)
    kinds = segments.groupBy("lead", "content").agg(
        F.min(F.struct("doc_id", F.expr(_LEAD_AT).alias("at"), "place")).alias("m"),
        F.first("bytes", ignorenulls=True).alias("bytes"),
        F.count("*").alias("n"),
    )
    kinds = materialise(
        kinds.select("lead", "content", "m.doc_id", "m.place", "bytes", "n"), "kinds"
    )
    release(spark)
    several = materialise(
        kinds.groupBy("lead")
        .agg(F.count("*").alias("kinds"), F.sum(F.length("bytes")).alias("size"))
        .where("kinds > 1"),
        "several",
    )
    size = several.where(f"kinds <= {unit.crowd}").agg(F.sum("size")).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES + 1)
    # Of all segments, fewer than one in ``crowd`` can be such a leader.
    crowded = F.broadcast(several.where(f"kinds > {unit.crowd}").select("lead"))
    columns = ["lead", "content", "doc_id", "place", "bytes"]
    compared = (
        kinds.select(*columns)
        .join(crowded, "lead", "left_anti")
        .repartition(shards, "lead")
        .join(several.select("lead").repartition(shards, "lead").hint("shuffle_hash"), "lead")
        .select(*columns)
        .mapInArrow(resolver, "lead long, content long, low int, high int")
    )
    crowd = materialise(kinds.select(*columns).join(crowded, "lead").select(*columns), "crowd")
    inner = (
        compared.groupBy("lead", "content")
        .agg(F.collect_set(F.struct("low", "high")).alias("inner"))
        .unionByName(_crowded(crowd, unit))
    )
    known = materialise(
        kinds.select("lead", "content", F.col("doc_id").alias("first_doc"), F.col("place").alias("first_place"), "n")
        .join(inner, ["lead", "content"], "left")
        .where("n > 1 or inner is not null"),
        "known",
    )
    release(spark)
    occurrences = spread_join(
        segments.select("lead", "content", "doc_id", "place"), known, ["lead", "content"], ["doc_id", "place"]
    )
    window = unit.window
    start = "shiftright(place, 16)"
    later = (
        f"(doc_id != first_doc or {_LEAD_AT} != shiftright(first_place, 16) + (first_place & 255))"
    )
    whole = (
        f"array(struct({start} as start, {start} + (shiftright(place, 8) & 255) + {window} as end))"
    )
    part = (
        f"transform(inner, x -> struct({start} + x.low as start, {start} + x.high - 1 + {window} as end))"
    )
    ranges = materialise(
        occurrences.select("doc_id", F.expr(f"if({later}, {whole}, {part})").alias("r"))
        .where("r is not null")
        .groupBy("doc_id")
        .agg(F.flatten(F.collect_set("r")).alias("ranges")),
        "ranges",
    )
    for table in (segments, kinds, several, crowd, known):
        forget(table)
    release(spark)
    return ranges
