"""Stages of the pipeline on planted corpora."""

import random
import re
import time
from pathlib import Path

import pytest

import corpus_pipeline

DOC = "doc_id long, text string"


@pytest.mark.parametrize("n_toxic", [200, 4, 0])
def test_mixing_stage_keeps_clean_documents(spark, tmp_path, n_toxic):
    """5 %, 0.1 % and no toxic documents among 4000: exactly the toxic ones go."""
    rng = random.Random(n_toxic)
    docs, labels = [], []
    for i in range(4000):
        kind = "toxic" if i < n_toxic else "poor" if i % 10 == 9 else "good"
        docs.append((i, " ".join(f"{kind}{rng.randrange(30)}" if k % 2 else f"any{rng.randrange(50)}" for k in range(40))))
        labels.append((i, int(kind != "poor"), int(kind == "toxic")))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.source_mixing(spark, spark.createDataFrame(docs, DOC), str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == list(range(n_toxic, 4000))


def test_near_dedup_stage_against_brute_force(spark):
    """Families of near copies, most of their similarities between 75 and 90 %: links are from 80 % on."""
    rng = random.Random(11)
    docs = []
    for family in range(30):
        base = [f"w{rng.randrange(5000)}" for _ in range(300)]
        docs.append((10 * family, " ".join(base)))
        for copy in range(1, 4):
            at = set(rng.sample(range(20, 280), rng.randint(3, 9)))
            docs.append((10 * family + copy, " ".join(f"x{copy}" if i in at else w for i, w in enumerate(base))))
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, t.split()) for d, t in docs)}
    pairs = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and a // 10 == b // 10}
    assert sum(0.8 <= s < 0.85 for s in pairs.values()) >= 10 and sum(s < 0.8 for s in pairs.values()) >= 10
    group = {d: d for d in sets}
    for _ in sets:
        for (a, b), s in pairs.items():
            if s >= 0.8:
                group[a] = group[b] = min(group[a], group[b])
    out = corpus_pipeline.near_deduplication(spark, spark.createDataFrame(docs, DOC), "").collect()
    assert {r.doc_id for r in out} == {d for d in sets if group[d] == d}


def test_stages_give_back_memory_that_the_driver_has_freed(spark, sf_dir):
    """Native buffers, most of them freed between ones in use: the JVM holds them until it is asked."""
    jvm = spark.sparkContext._jvm
    status = Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status")
    docs = spark.createDataFrame([(1, "some words", 10)], "doc_id long, text string, n_chars long")
    corpus_pipeline.decontamination(spark, docs, sf_dir)  # what it loads and compiles stays
    buffers = [jvm.java.util.zip.Deflater() for _ in range(1200)]
    for i, buffer in enumerate(buffers):
        if i % 40:
            buffer.end()
    jvm.System.gc()
    time.sleep(3)  # the heap shrinks a moment later
    before = int(re.search(r"VmRSS:\s+(\d+)", status.read_text())[1])
    corpus_pipeline.decontamination(spark, docs, sf_dir)
    after = int(re.search(r"VmRSS:\s+(\d+)", status.read_text())[1])
    for buffer in buffers[::40]:
        buffer.end()
    assert before - after > 40 * 1024
