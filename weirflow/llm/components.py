"""Connected components of a distributed link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.llm.common import forget, materialise


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for all ids of ``links(a, b)``: the smallest id reachable.

    Each round sends labels over the links and then follows each label once
    more, so the rounds grow with the logarithm of the longest chain. Labels are
    written to the shared scratch folder each round; nothing is collected.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a != b").distinct()
    both = materialise(both, "links")
    labels = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as id", "least(a, m) as label")
    labels = materialise(labels, "labels")
    while True:
        heard = (
            both.join(labels, F.col("a") == F.col("id"))
            .groupBy(F.col("b").alias("id"))
            .agg(F.min("label").alias("heard"))
        )
        lower = labels.join(heard, "id").select(
            "id", "label", F.least("label", "heard").alias("next")
        )
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("far"))
        stepped = materialise(
            lower.join(jump, "next").select("id", "label", F.least("next", "far").alias("after")),
            "labels",
        )
        moved = stepped.where("after != label").limit(1).count()
        forget(labels)
        labels = stepped.selectExpr("id", "after as label")
        if not moved:
            return labels.withColumnRenamed("label", "component")
        labels = materialise(labels, "labels")
