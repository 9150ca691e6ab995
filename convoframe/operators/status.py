"""App status: health, reports, deployments, time until an app is up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoframe.functions import ids, logs
from convoframe.operators.blocks import Blocks
from convoframe.session import materialise


def classify_health(
    status: DataFrame, app_state: str = "app_state", compute_state: str = "compute_state"
) -> DataFrame:
    """C4: adds ``health``; a missing state counts as Unknown."""
    return status.withColumn("health", logs.health(F.col(app_state), F.col(compute_state)))


def health_summary(status: DataFrame) -> DataFrame:
    """A4: rows per health class."""
    return classify_health(status).groupBy("health").agg(F.count(F.lit(1)).alias("n"))


def recent_deployments(
    deployments: DataFrame, n: int = 3, by: str = "app_id", time: str = "create_time"
) -> DataFrame:
    """The newest ``n`` deployments per app, ranked from 1. The limit also runs before the
    shuffle, so an app with very many deployments sends ``n`` rows per task."""
    newest = Window.partitionBy(by).orderBy(F.col(time).desc(), "deployment_id")
    ranked = deployments.withColumn("rank", F.row_number().over(newest).cast("bigint"))
    return ranked.where(F.col("rank") <= n)


def status_list(status: DataFrame) -> DataFrame:
    """The all-apps list: name and state or Unknown."""
    return status.select(
        "name", F.coalesce("app_status.state", F.lit("Unknown")).alias("app_state")
    )


def status_report(status: DataFrame, deployments: DataFrame, by: str = "app_id") -> DataFrame:
    """The nested status document as one flat row, with health and recent deployments.

    The history is at most three deployments per app, so the joined side has one short row per app. It is
    written, so that Spark may split the rows of an app with very many status documents in the join.
    """

    def known(column: str, default: str = "Unknown") -> Column:
        return F.coalesce(column, F.lit(default))

    active = F.col("active_deployment").isNotNull()
    short_id = F.concat(F.substring(known("active_deployment.deployment_id"), 1, 8), F.lit("..."))
    recent = (
        recent_deployments(deployments, by=by)
        .groupBy(by)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("rank", known("state").alias("state"), "create_time"))
            ).alias("recent")
        )
    )
    recent = materialise(recent, "recent-deployments")
    flat = status.select(
        *[c for c in status.columns if c not in _NESTED],
        known("url", "Not available").alias("url"),
        known("app_status.state").alias("app_state"),
        known("app_status.message", "No message").alias("app_message"),
        known("compute_status.state").alias("compute_state"),
        known("compute_status.message", "No message").alias("compute_message"),
        F.when(active, short_id).alias("deployment"),
        F.when(active, known("active_deployment.status.state")).alias("deployment_state"),
        F.when(active, known("active_deployment.status.message", "No message")).alias(
            "deployment_message"
        ),
        F.when(active, known("active_deployment.create_time")).alias("created"),
        F.when(active, known("active_deployment.update_time")).alias("updated"),
        F.when(active, known("active_deployment.creator")).alias("creator"),
    )
    return (
        classify_health(flat)
        .withColumn("platform", ids.second_label(F.col("url")))
        .join(recent, by, "left")
    )


_NESTED = ("url", "app_status", "compute_status", "active_deployment")


def time_to_state(
    status: DataFrame,
    start: Column,
    ready: Column,
    timeout: int = 300,
    poll_every: int | None = None,
    by: str = "app_id",
    ts: str = "ts",
    tie: str = "event_id",
    partitions: int | None = None,
) -> DataFrame:
    """For each start row, when the same app is first ready afterwards, or that it timed out.

    Every start looks ahead for one time only, so starts and ready rows are never paired up: a
    running minimum over the app's rows in falling time order carries the next ready time. The
    order puts starts before ready rows of the same instant, so readiness is strictly later.

    ``timeout`` is in seconds and inclusive. With ``poll_every`` the state is looked at only every
    so many seconds, from the start on: readiness is seen at the first look after it, looks stop
    before ``timeout``, and the elapsed text counts the look's whole interval. Rows without a time
    are neither starts nor ready.
    """
    kinds = F.array_compact(F.array(F.when(start, F.lit(0)), F.when(ready, F.lit(1))))
    rows = status.where(F.col(ts).isNotNull()).select(
        by, F.col(ts).alias("ts"), F.col(tie).alias("_tie"), F.explode(kinds).alias("_kind")
    )
    in_time = [F.col("ts"), F.col("_kind").desc(), F.col("_tie")]
    blocks = Blocks(rows, [by], in_time, partitions)
    ready_ts = F.when(F.col("_kind") == 1, F.col("ts"))
    backwards = Window.partitionBy(*blocks.by).orderBy(F.col("ts").desc(), "_kind", F.col("_tie").desc())
    seen = backwards.rowsBetween(Window.unboundedPreceding, -1)
    near = blocks.rows.withColumn("_near", F.min(ready_ts).over(seen)).where("_kind = 0")
    opening = blocks.rows.groupBy(*blocks.by).agg(F.min(ready_ts).alias("_first"))
    later = (
        Window.partitionBy(by)
        .orderBy(F.col(blocks.block).desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = opening.select(*blocks.by, F.min("_first").over(later).alias("_later"))
    next_ready = blocks.with_carry(near, carry).select(
        by,
        F.col("_tie").alias(tie),
        F.col("ts").alias("start_ts"),
        F.coalesce("_near", "_later").alias("_ready"),
    )
    waited = (F.col("_ready") - F.col("start_ts")).cast("interval second").cast("decimal(20,6)")
    if poll_every is None:
        in_time = F.col("_waited") <= timeout
        shown = F.col("_waited")
    else:
        look = F.ceil(F.col("_waited") / poll_every) * poll_every
        in_time = look < timeout
        shown = look + poll_every
    return next_ready.withColumn("_waited", waited).select(
        by,
        tie,
        "start_ts",
        F.when(in_time, F.lit("ready")).otherwise(F.lit("timeout")).alias("outcome"),
        F.when(in_time, F.col("_ready")).alias("ready_ts"),
        F.when(in_time, F.col("_waited")).alias("elapsed_s"),
        F.when(in_time, logs.elapsed_text(shown)).alias("elapsed"),
    )
