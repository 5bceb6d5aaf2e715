"""Rows without an id are judged alike on both paths of the decontamination."""

import pytest

from weirflow.llm import decontaminate


@pytest.mark.parametrize("limit", [decontaminate.INDEX_BYTES, 0])
def test_rows_without_an_id(spark, limit):
    passage = " ".join(f"p{i}" for i in range(20))
    docs = [(None, f"x {passage} y"), (None, "clean text"), (None, None), (1, passage), (2, "clean text")]
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items, limit).collect()
    hits = sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in got)
    assert hits == [(0, 0, 0), (0, 2, 0), (0, 22, 20), (1, 20, 20), (2, 2, 0)]
