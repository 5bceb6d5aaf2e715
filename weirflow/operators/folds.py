"""Ordered computations over keys that may hold a large part of all rows.

What adds up is computed range by range of the order column, with what came
before a range carried into it, so a key is spread over many tasks. What depends
on the state after the row before is folded in order; a task then holds the
state and one Arrow batch, never a key's whole history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, key: str, at: str, value: Column, width: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` over the key's rows up to each, peers included.

    ``width``: units of ``at`` that make a range, which one task sorts for a key.
    """
    dealt = rows.withColumns({"__range": F.floor(F.col(at) / width), "__value": value})
    totals = dealt.groupBy(key, "__range").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(key, "__range").orderBy(at)
    return (
        dealt.join(before, [key, "__range"])
        .withColumn(out, F.sum("__value").over(inside) + F.col("__before"))
        .drop("__range", "__value", "__before")
    )


def sliding_share(rows: DataFrame, key: str, at: Column, flag: Column, span: int, width: int, out: str) -> DataFrame:
    """``rows`` with ``out``: the share of true flags in the key's rows of the last ``span`` units, both ends included.

    Null flags do not count; rows without a time see each other only. A row is
    dealt to its range of ``width`` units, or of ``span`` if that is more, and once
    more to the next one if that one's windows reach back to it. A window is what
    the range has up to its end less what it has before its begin: two counts that
    only grow, so the work does not depend on how many rows a window holds.
    """
    width = max(width, span)
    own = F.floor(F.col("__at") / width)
    both = F.when(F.col("__at") + span >= (own + 1) * width, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumns({"__at": at, "__flag": flag}).withColumn("__range", F.explode(both))
    order = Window.partitionBy(key, "__range").orderBy("__at")

    def counted(value: Column) -> Column:
        upto = F.count(value).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        before = F.count(value).over(order.rangeBetween(Window.unboundedPreceding, -span - 1))
        return upto - F.when(F.col("__at").isNull(), 0).otherwise(before)

    counts = {"__hits": counted(F.when(F.col("__flag"), 1)), "__known": counted(F.col("__flag"))}
    return (
        dealt.withColumns(counts)
        .where(F.col("__range").eqNullSafe(own))
        .withColumn(out, F.when(F.col("__known") > 0, F.col("__hits") / F.col("__known")))
        .drop("__at", "__flag", "__range", "__hits", "__known")
    )


def ordered_fold(
    rows: DataFrame,
    key: str,
    order: list[str],
    start: Callable[[], Any],
    step: Callable[[Any, tuple], tuple],
    schema: str,
) -> DataFrame:
    """One row out for each row in: ``step(state, row)``, in order within each key.

    Keys are dealt over the tasks and sorted there; a task streams its rows and
    keeps the state of one key at a time.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    columns = rows.columns
    place = columns.index(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, current = None, object()
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False, name=None):
                if row[place] != current:
                    state, current = start(), row[place]
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)
