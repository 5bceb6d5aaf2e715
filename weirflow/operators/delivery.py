"""Delivery: retries, ordered dispatch, fallbacks, acknowledged offsets, fan-out tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retry_schedule(plans: DataFrame) -> DataFrame:
    """One row for each attempt of ``plans``; attempts take no time themselves.

    ``plans(id, retries, backoff_min, backoff_max, max_attempts, max_elapsed,
    base_backoff, max_backoff)``: the first three of a route's delivery policy,
    the others of its budget; any may be null. Attempts are ``retries + 1`` within
    ``max_attempts``, at least one. Waits begin at the policy's least, raised to
    the budget's base, and double up to the policy's greatest, lowered to the
    budget's but not below the first. There is no further attempt once
    ``max_elapsed`` is used up or the wait would go beyond it.
    """
    none = F.lit(2**31 - 1)
    attempts = F.greatest(F.lit(1), F.least(F.coalesce(F.col("retries") + 1, none), F.greatest(F.coalesce("max_attempts", none), F.lit(1))))
    base = F.greatest(F.coalesce("backoff_min", "base_backoff", F.lit(0)), F.coalesce("base_backoff", F.lit(0)))
    most = F.least(F.coalesce("backoff_max", "max_backoff", "base"), F.coalesce("max_backoff", "backoff_max", "base"))
    rows = (
        plans.withColumn("base", base)
        .withColumn("most", F.greatest(most, "base"))
        .withColumn("attempt", F.explode(F.sequence(F.lit(1), attempts.cast("int"))))
    )
    wait = F.least(F.col("base") * F.pow(F.lit(2), F.least(F.col("attempt") - 2, F.lit(16))), "most")
    rows = rows.withColumn("delay_ms", F.when(F.col("attempt") == 1, 0).otherwise(wait).cast("bigint"))
    so_far = Window.partitionBy("id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("start_ms", F.sum("delay_ms").over(so_far))
    before = F.col("start_ms") - F.col("delay_ms")
    in_time = (before < F.col("max_elapsed")) & (F.col("start_ms") <= F.col("max_elapsed"))
    kept = F.col("max_elapsed").isNull() | in_time | (F.col("attempt") == 1)
    return rows.where(kept).select("id", "attempt", "delay_ms", "start_ms")


def ordered_dispatch(actions: DataFrame, event: str = "event_id", idx: str = "idx", failed: str = "failed") -> DataFrame:
    """Outcome of actions sent in order: the first failure of an event aborts what follows it."""
    first = actions.groupBy(event).agg(F.min(F.when(F.col(failed), F.col(idx))).alias("__first"))
    outcome = (
        F.when(F.col("__first").isNull() | (F.col(idx) < F.col("__first")), "sent")
        .when(F.col(idx) == F.col("__first"), "failed")
        .otherwise("aborted")
    )
    return actions.join(first, event).withColumn("outcome", outcome).drop("__first")


def with_fallback(actions: DataFrame, fallbacks: DataFrame) -> DataFrame:
    """Failed actions once more on the fallback of their connector; without one they stay failed.

    ``fallbacks(connector, fallback)`` is configuration, a row for each connector at most.
    """
    joined = actions.join(fallbacks, "connector", "left")
    rescued = joined.where(F.col("failed") & F.col("fallback").isNotNull())
    moved = rescued.withColumns({"connector": F.col("fallback"), "delivery": F.lit("fallback"), "failed": F.lit(False)})
    state = F.when(~F.col("failed"), "primary").when(F.col("fallback").isNotNull(), "replaced").otherwise("dead_letter")
    return joined.withColumn("delivery", state).unionByName(moved).drop("fallback")


def committed_offsets(records: DataFrame) -> DataFrame:
    """Last committed offset of each partition: a later success commits what failed before it."""
    good = F.when(F.col("ok"), F.col("offset"))
    return records.groupBy("topic", "partition").agg(F.max(good).alias("committed"), F.count("*").alias("seen"))


def skipped_records(records: DataFrame) -> DataFrame:
    """Failed records that a later commit of their partition has passed over."""
    passed = committed_offsets(records).select("topic", "partition", "committed")
    return records.where(~F.col("ok")).join(passed, ["topic", "partition"]).where("offset < committed").select("topic", "partition", "offset")


def tally(children: DataFrame, quorum: int | None = None) -> DataFrame:
    """Tallies of each event's children and whether they meet each aggregation.

    ``children(event, status)`` with success, failed, timeout or skipped; skipped
    ones do not count. A quorum defaults to half of the children, rounded up.
    """
    one = F.lit(1).cast("bigint")
    needed = {
        "every": F.col("counted"),
        "some": F.least(one, F.col("counted")),
        "quorum": F.lit(quorum).cast("bigint") if quorum else F.ceil(F.col("children") / 2),
    }
    counts = children.groupBy("event").agg(
        F.count_if(F.col("status") == "success").alias("successes"),
        F.count_if(F.col("status").isin("failed", "timeout")).alias("failures"),
        F.count_if(F.col("status") != "skipped").alias("counted"),
        F.count("*").alias("children"),
    )
    return counts.withColumns({name: F.col("successes") >= need for name, need in needed.items()})


def child_status(failed: Column, late: Column, optional: Column) -> Column:
    """Status of a fan-out's child: what fails in time is skipped if it is optional."""
    return F.when(late, "timeout").when(failed & optional, "skipped").when(failed, "failed").otherwise("success")
