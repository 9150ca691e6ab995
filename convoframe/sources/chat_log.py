"""A chat table kept as written batches.

Each save adds a folder ``run=<r>/batch=<n>``; a reader takes the newest row per key, of a chat in parts the
newest save whole. Saving costs the size of the batch, not of the table, no path is read and overwritten
at once, and writing a batch again (after a lost executor, or when a stream repeats it) leaves the same
table. A run is one writer, such as a stream with its checkpoint: writers do not touch each other's
batches. Later runs, by the time of their first save, win over earlier ones, and later batches of a run
over its earlier ones.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoframe.functions.names import free
from convoframe.operators.chats import latest
from convoframe.session import materialise

RUN = "run"
BATCH = "batch"
# When a row was saved, in microseconds of the writer's clock.
SAVED = "saved_at"
# Runs whose beginnings are broadcast (a short id and a number each).
BROADCAST_RUNS = 10_000


def write_batch(df: DataFrame, path: str, batch: int, run: str = "0", saved_at: int | None = None) -> None:
    """Add, or replace, one batch of a run."""
    moment = time.time_ns() // 1_000 if saved_at is None else saved_at
    rows = df.withColumn(SAVED, F.lit(moment).cast("bigint"))
    rows.write.mode("overwrite").parquet(f"{path}/{RUN}={run}/{BATCH}={batch}")


def read_current(
    spark: SparkSession,
    path: str,
    schema,
    keys: tuple[str, ...] = ("chat_id",),
    version: tuple[str, ...] = (),
) -> DataFrame:
    """The newest row (or save, see ``latest``) per key; ``version`` orders rows within a batch."""
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    placed = [T.StructField(SAVED, T.LongType()), T.StructField(RUN, T.StringType()), T.StructField(BATCH, T.LongType())]
    rows = spark.read.schema(T.StructType([*fields.fields, *placed])).parquet(path)
    # One row per run, from the save times alone. A run is a writer, so there are few; a table of very many
    # is joined as Spark sees fit, else all rows of one writer's table would be shuffled to one task.
    first = free(rows, "_began")
    began = materialise(rows.groupBy(RUN).agg(F.min(SAVED).alias(first)), "runs")
    began = F.broadcast(began) if began.count() <= BROADCAST_RUNS else began
    rows = rows.join(began, RUN)
    return latest(rows, [first, RUN, BATCH, *version], tuple(keys)).drop(RUN, BATCH, SAVED, first)


def compact(
    spark: SparkSession, path: str, new_path: str, schema, keys=("chat_id",), version=()
) -> None:
    """Write the current rows as the first batch of a new path; later batches are added there."""
    write_batch(read_current(spark, path, schema, keys, version), new_path, 0, saved_at=0)
