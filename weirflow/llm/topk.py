"""Exact top-k inner products by Fagin's threshold algorithm.

Candidates lie in blocks. A block holds one list of its vectors for each
dimension, sorted by that component. A query reads each list from its best end,
all lists to the same depth, round by round; what it meets is scored in full.
It stops once the bound of everything unread cannot reach its k-th score, or
once it has met every vector. The blocks' results meet in a pre-aggregated
top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weirflow.llm.common import materialise

K = 5
#: Vectors of a candidate block and of a query block.
BLOCK, QUERIES = 4096, 2048
#: Depth of the first reading, and queries whose full scores are one product.
_DEPTH, _TOGETHER = 16, 256


class Lists:
    """A block's vectors and, for each dimension, the list of them sorted by that component.

    ``rows`` tells rows apart that share an id. ``reads`` counts the entries that
    were read from the lists.
    """

    def __init__(self, ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((rows, ids))
        self.ids, self.rows, self.vectors = ids[order], rows[order], vectors[order]
        self.order = np.argsort(self.vectors, axis=0, kind="stable")  # a column is a list, least first
        self.ascending = np.take_along_axis(self.vectors, self.order, axis=0)
        self.reads = 0

    def _read(self, query: np.ndarray, low: int, high: int, seen: np.ndarray) -> None:
        """Mark in ``seen`` what the query's lists hold at the depths ``low`` to ``high - 1``."""
        n = len(self.ids)
        down, up = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen[self.order[n - high : n - low, down].ravel()] = True
        seen[self.order[low:high, up].ravel()] = True
        self.reads += (high - low) * (len(down) + len(up))

    def top(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """For each query the ``k`` best ``(score, id)``, ties to smaller ids, without its own row."""
        largest = float(np.abs(self.vectors).max(initial=0)) * float(np.abs(queries).max(initial=0))
        kind = np.float64 if largest * queries.shape[1] < 2.0**52 else object  # exact either way
        vectors, queries = self.vectors.astype(kind), queries.astype(kind)
        ascending = self.ascending.astype(kind)
        n = len(self.ids)
        out: list[list[tuple[int, int]]] = [[] for _ in queries]
        seen = np.zeros((len(queries), n), bool)
        seen[(queries == 0).all(axis=1)] = True  # no list says anything, all scores are 0
        mine = own[:, None] == self.rows
        score = np.zeros(seen.shape, kind)
        scored = np.zeros(n, bool)
        active, before, depth = np.arange(len(queries)), 0, min(n, _DEPTH)
        while len(active):
            for i in active:
                if not seen[i].all():
                    self._read(queries[i], before, depth, seen[i])
            met = np.flatnonzero(seen[active].any(axis=0) & ~scored)
            score[:, met] = queries @ vectors[met].T  # one product for all queries of the set
            scored[met] = True
            # What no list has shown yet cannot exceed this.
            high, low = ascending[max(n - depth, 0)], ascending[min(depth, n) - 1]
            q = queries[active]
            bound = np.where(q > 0, q, 0) @ high + np.where(q < 0, q, 0) @ low
            stay = []
            for i, row in enumerate(active):
                rows = np.flatnonzero(seen[row] & ~mine[row])
                values = score[row, rows]
                if len(rows) > k:
                    least = np.sort(values)[-k] if kind is object else np.partition(values, -k)[-k]
                    good = values >= least
                    rows, values = rows[good], values[good]
                by = np.argsort(-values, kind="stable")[:k]  # rows are in id order: ties to smaller ids
                if depth < n and not seen[row].all() and (len(by) < k or bound[i] >= values[by[-1]]):
                    stay.append(row)
                else:
                    out[row] = [(int(values[j]), int(self.ids[rows[j]])) for j in by]
            active, before, depth = np.array(stay, np.int64), depth, min(n, depth * 2)
        return out


#: Scores travel as two parts, so that those beyond a long are ranked too.
_PART = 62


def _search(k: int):
    def search(_key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int, int, int]] = []
        if len(queries) and len(block):
            lists = Lists(block.vec_id.to_numpy(), block.row.to_numpy(), np.stack(block.v.to_numpy()))
            for low in range(0, len(queries), _TOGETHER):
                some = queries.iloc[low : low + _TOGETHER]
                own, ids = some.query_row.to_numpy(), some.query_id.to_numpy()
                tops = lists.top(np.stack(some.q.to_numpy()), own, k)
                found += [
                    (r, q, vec, score >> _PART, score & ((1 << _PART) - 1))
                    for r, q, top in zip(own, ids, tops, strict=True)
                    for score, vec in top
                ]
        return pd.DataFrame(found, columns=["query_row", "query_id", "vec_id", "high", "low"]).astype("int64")

    return search


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, row, v``: components x as floor(256 * x); ``row`` tells equal ids apart.

    Left out are vectors that are null or empty, hold a null or non-finite
    component or one whose integer is no long (2**55 and beyond), and rows without
    an id. Every other row counts, also if it is equal to another one.
    """
    wide = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e")
    )
    fit = "forall(e, x -> x is not null and not isnan(x) and abs(x) < 36028797018963968D)"
    whole = wide.where(f"vec_id is not null and size(e) > 0 and {fit}").select(
        "vec_id", F.expr("transform(e, x -> cast(floor(256 * x) as bigint))").alias("v")
    )
    equal = whole.groupBy("vec_id", "v").agg(F.count("*").cast("int").alias("n"))
    rows = equal.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return rows.select("vec_id", F.xxhash64("vec_id", "v", "copy").alias("row"), "v")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best other rows.

    Args:
        vectors: ``vec_id, row, v`` as of :func:`integers`; ``queries``: a subset of
            it. A query meets vectors of its own length only. Each row is a query
            or a candidate of its own, also where rows share an id. Without
            vectors or queries there are no rows. Ranks are exact; a score beyond
            a long is given as the nearest long.
    """
    vectors = materialise(vectors, "vectors")
    queries = vectors.join(queries.select("row"), "row", "left_semi")
    blocks = max(1, -(-vectors.count() // BLOCK))
    sets = max(1, -(-queries.count() // QUERIES))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select(
        F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.size("v").alias("dims"),
        F.pmod(F.xxhash64("row"), F.lit(sets)).cast("int").alias("part"), spread(blocks).alias("block"),
    )
    right = vectors.select(
        "vec_id", "row", "v", F.size("v").alias("dims"),
        F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)).cast("int").alias("block"), spread(sets).alias("part"),
    )
    keys = ["dims", "part", "block"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(_search(k), "query_row long, query_id long, vec_id long, high long, low long")
    )
    best = Window.partitionBy("query_row", "query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    score = (
        F.when(F.col("high") > 1, F.lit(2**63 - 1)).when(F.col("high") < -2, F.lit(-(2**63)))
        .otherwise(F.shiftleft("high", _PART) + F.col("low"))
    )
    ranked = found.withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integers(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
with v as (
  select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.r, q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.r <> q.r and len(q.v) = len(c.v)
)
select query_id, cast(row_number() over (partition by r order by score desc, vec_id) as integer) as rank,
       vec_id, score
from scored
qualify row_number() over (partition by r order by score desc, vec_id) <= 5
"""
