"""Byte and word repeat removal against brute force."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from weirflow.llm import anchors, rlz_dedup, suffix_dedup
from weirflow.llm.induced import MEMORY, induce, suffix_order

SCHEMA = "doc_id long, text string"


def brute(docs, window, join):
    """``docs``: sorted (doc_id, sequence); which places a window that started earlier covers."""
    seen, out = set(), {}
    for doc, seq in docs:
        hit = [False] * len(seq)
        for i in range(len(seq) - window + 1):
            w = join(seq[i : i + window])
            if w in seen:
                hit[i : i + window] = [True] * window
            seen.add(w)
        out[doc] = hit
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcéß") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    passages = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(15, 60))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40)))]
        for _ in range(rng.randint(0, 3)):
            parts.append(rng.choice(passages))
            parts.append(rng.choice(["", "\n", "  ", "-" * 150, "x y " * 40]))
        texts.append(rng.choice(["", " ", "\t"]).join(parts))
    texts += [texts[3]] * 5 + ["", "a", "=" * 400, "ab" * 300]
    return list(enumerate(texts)) + [(500, None)]


@pytest.mark.parametrize("crowd", [2, 256])
def test_bytes(spark, crowd):
    docs = corpus(1)
    got = suffix_dedup.remove_repeated_bytes(spark.createDataFrame(docs, SCHEMA), crowd=crowd).collect()
    want = brute([(d, (t or "").encode()) for d, t in docs], 100, bytes)
    assert len(got) == len(docs)
    texts = {d: (t or "").encode() for d, t in docs}
    for row in got:
        hit = want[row.doc_id]
        kept = bytes(b for b, h in zip(texts[row.doc_id], hit, strict=True) if not h)
        assert bytes(row.kept) == kept
        assert row.n_bytes == len(texts[row.doc_id])
        assert sum(r.end - r.start for r in row.removed) == sum(hit)
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        assert len(row.removed) == runs


@pytest.mark.parametrize("crowd", [2, 256])
def test_words(spark, crowd):
    docs = corpus(2)
    got = rlz_dedup.remove_repeated_passages(spark.createDataFrame(docs, SCHEMA), crowd=crowd).collect()
    seqs = {d: (t or "").encode().split() for d, t in docs}
    want = brute(sorted(seqs.items()), 20, tuple)
    assert len(got) == len(docs)
    for row in got:
        hit = want[row.doc_id]
        kept = [w for w, h in zip(seqs[row.doc_id], hit, strict=True) if not h]
        assert row.kept.encode() == b" ".join(kept)
        assert row.n_words == len(hit)


@pytest.mark.parametrize("operator", [suffix_dedup.remove_repeated_bytes, rlz_dedup.remove_repeated_passages])
def test_edges(spark, operator):
    empty = operator(spark.createDataFrame([], SCHEMA + ", lead long"))
    assert empty.collect() == []
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, 1), (7, text, 1), (7, text, 1), (9, text, 1), (8, None, 1)]
    got = operator(spark.createDataFrame(rows, SCHEMA + ", lead long")).collect()
    kept = sorted((r.doc_id or 0, bool(r.kept)) for r in got)
    assert kept == [(0, True), (7, True), (7, True), (8, False), (9, False)]


def test_digests(spark, sf_dir):
    got = {r.doc_id: r for r in suffix_dedup.query(spark, sf_dir).collect()}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    texts = sorted((r.doc_id, (r.text or "").encode()) for r in rows)
    want = brute(texts, 100, bytes)
    assert len(got) == len(texts)
    for doc, text in texts:
        kept = bytes(b for b, h in zip(text, want[doc], strict=True) if not h)
        assert got[doc].kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert got[doc].n_removed == sum(want[doc])
    words = {r.doc_id: r for r in rlz_dedup.query(spark, sf_dir).collect()}
    seqs = [(d, t.split()) for d, t in texts]
    want = brute(seqs, 20, tuple)
    for doc, seq in seqs:
        kept = b" ".join(w for w, h in zip(seq, want[doc], strict=True) if not h)
        assert words[doc].kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("limits", [{}, {"memory": 300, "depth": 3}])
def test_induced_order(limits):
    rng = np.random.default_rng(5)
    for turn in range(60):
        text = rng.integers(1, rng.integers(2, 5), rng.integers(1, 60))
        text = np.append(np.tile(text, 1 + turn % 3), 0).astype(np.int64)
        suffixes = [tuple(text[i:]) for i in range(len(text))]
        order = sorted(range(len(text)), key=suffixes.__getitem__)
        assert suffix_order(text, **limits).tolist() == order
        places, prefixes = [], []
        induce(text, 7, lambda p, v, _: (places.extend(p.tolist()), prefixes.extend(v.tolist())), **limits)
        assert places[::-1] == order
        for a, b, value in zip(order, order[1:], prefixes[::-1], strict=False):
            common = 0
            while common < 7 and suffixes[a][common : common + 1] == suffixes[b][common : common + 1] != ():
                common += 1
            assert value == common


def shard(segments):
    """A resolver's input: segments of one leader in documents 0, 1, ..., from the start of each."""
    places = [(max(len(x) - 100, 0) << 8) for x in segments]
    ids = pa.array(range(len(segments)), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([5] * len(segments), pa.int64()), ids, ids, pa.array(places, pa.int64()), pa.array(segments, pa.binary())],
        ["lead", "content", "doc_id", "place", "bytes"],
    )


@pytest.mark.parametrize("symbols", [4, 253, 254, 256])
def test_shard_of_any_bytes(symbols):
    rng = np.random.default_rng(symbols)
    passages = [rng.integers(0, symbols, 150).astype(np.uint8).tobytes() for _ in range(4)]
    segments = [bytes(range(symbols))] if symbols > 4 else []
    for i in range(40):
        own = rng.integers(0, symbols, i).astype(np.uint8).tobytes()
        segments.append((own + passages[i % 4])[: 60 + 5 * i])
    got = [set() for _ in segments]
    for batch in suffix_dedup._resolver(100, MEMORY)(iter([shard(segments)])):
        for row in batch.to_pylist():
            got[row["content"]].update(range(row["low"], row["high"]))
    seen = set()
    for segment, found in zip(segments, got, strict=True):
        windows = [segment[i : i + 100] for i in range(len(segment) - 99)]
        want = set()
        for i, w in enumerate(windows):
            if w in seen:
                want.add(i)
            seen.add(w)
        assert found == want


def test_shard_memory():
    rng = np.random.default_rng(3)
    passages = [rng.integers(97, 123, 180).astype(np.uint8) for _ in range(1500)]
    segments = []
    for i in range(6000):
        one = passages[i % 1500].copy()
        one[rng.integers(0, 180, 2)] = 45
        segments.append(one.tobytes())
    batch = shard(segments)
    list(suffix_dedup._resolver(100, MEMORY)(iter([batch.slice(0, 100)])))
    tracemalloc.start()
    list(suffix_dedup._resolver(100, MEMORY)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 180 * len(segments)


def test_leaders_are_hashed_in_blocks_that_stay_in_cache(monkeypatch):
    sizes = []
    whole = anchors._byte_grams
    monkeypatch.setattr(anchors, "_byte_grams", lambda data, k: sizes.append(len(data)) or whole(data, k))
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 400_000).astype(np.uint8)
    offsets = np.arange(0, len(data) + 1, 2000)
    found = list(anchors.runs(data, offsets, anchors.Unit("bytes", 100, 20)))
    assert max(sizes) <= 1 << 16
    row, first, last = (np.concatenate([getattr(r, c) for r in found]) for c in ("row", "first", "last"))
    windows = np.zeros((len(offsets) - 1, 1901), int)
    for i, low, high in zip(row, first, last, strict=True):
        windows[i, low : high + 1] += 1
    assert (windows == 1).all()


def test_ranges_of_rows_are_merged():
    rng = random.Random(6)
    lists = [None, []]
    for _ in range(50):
        starts = [rng.randint(0, 60) for _ in range(rng.randint(0, 6))]
        lists.append([{"start": s, "end": s + rng.randint(1, 9)} for s in starts])
    column = pa.array(lists + [None], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    for part, chosen in ((column, lists + [None]), (column.slice(9, 20), lists[9:29])):
        got = [x.tolist() for x in suffix_dedup._merged(part)]
        want = [
            (i, *r) for i, x in enumerate(chosen) for r in suffix_dedup.merge((r["start"], r["end"]) for r in x or ())
        ]
        assert list(zip(*got, strict=True)) == want
