"""Batch generation that takes up where an earlier run ended.

Answers go to a ledger: a folder of runs with one row for each call, keyed by a digest of the prompt and of
what is passed with it. The files of a task appear in the ledger when the task ends, not when the job does, so
that a job that is killed keeps the answers of its finished tasks. The next run calls only for prompts without an
answer. Equal prompts are called for once. A failed call is repeated until its class of errors has reached its limit.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.functions.names import free
from convoframe.operators.generate import batch_generate
from convoframe.session import materialise

LEDGER = "digest string, response string, error string"
# The limit of all classes of errors that are not named.
OTHERS = "*"


def prompt_digest(with_columns: tuple[str, ...] = ()) -> Column:
    """What a call depends on, as one digest: the prompt's messages and the columns passed with them."""
    whole = F.struct("prompt", *with_columns)
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}).cast("binary"), 256)


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All calls noted so far: digest, response, error. None if nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def settled(calls: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """``digest, response, error, done``: the answer of each digest, or its last class's error.

    A digest is done once it has an answer, or once the failures of one class have reached that class's limit. The
    class is the error's text up to the first colon.
    """
    failure = F.substring_index("error", ":", 1)
    most = F.lit(limits.get(OTHERS, 1))
    for name, limit in limits.items():
        if name != OTHERS:
            most = F.when(F.col("failure") == name, limit).otherwise(most)
    by_class = calls.groupBy("digest", failure.alias("failure")).agg(
        F.min("response").alias("response"), F.min("error").alias("error"), F.count(F.lit(1)).alias("n")
    )
    out = F.when(F.col("failure").isNotNull(), F.col("n") >= most).otherwise(True)
    # An answer counts before any failure, a class at its limit before others.
    least = F.min(F.struct(F.col("failure").isNotNull().alias("failed"), (~out).alias("open"), "response", "error"))
    best = by_class.groupBy("digest").agg(least.alias("best"))
    answer = F.when(~F.col("best.failed"), F.col("best.response")).alias("response")
    return best.select("digest", answer, F.col("best.error").alias("error"), (~F.col("best.open")).alias("done"))


def resume_generate(
    prompts: DataFrame,
    make_fn: Callable[[], Callable[[list[dict]], object]],
    ledger: str,
    limits: Mapping[str, int] | None = None,
    strip: bool = False,
    with_columns: tuple[str, ...] = (),
    calls_per_task: int = 200,
) -> DataFrame:
    """U1 over a ledger: ``chat_id, turn, *with_columns, response, error`` for each row of ``prompts``.

    ``make_fn`` is as in ``batch_generate``. ``limits`` gives how often a class of errors may occur for a prompt
    (``"*"`` for all others, 1 unless given); prompts below it are called again in this run. A task makes
    ``calls_per_task`` calls at the most: a lost task loses, and repeats, no more than these. Rows with equal prompts
    share an answer; null chats and turns and repeated rows are kept as they are. ``ledger`` is a folder of
    this model's alone.
    """
    spark, limits = prompts.sparkSession, dict(limits or {})
    if calls_per_task < 1 or min(limits.values(), default=1) < 1:
        raise ValueError("limits and calls_per_task are 1 or more")
    name = free(prompts, "digest")
    asked = materialise(prompts.withColumn(name, prompt_digest(with_columns)), "prompts")
    # The first of equal prompts stands for all; aggregated before the shuffle.
    each = asked.groupBy(F.col(name).alias("chat_id")).agg(
        *(F.first(c).alias(c) for c in ("prompt", *with_columns))
    )
    each = materialise(each.withColumn("turn", F.lit(0).cast("bigint")), "distinct-prompts")
    while True:
        state = materialise(settled(read_ledger(spark, ledger), limits), "settled")
        done = state.where("done").select(F.col("digest").alias("chat_id"))
        todo = materialise(each.join(done, "chat_id", "left_anti"), "open-prompts")
        n = todo.count()
        if not n:
            break
        dealt = todo.repartition(math.ceil(n / calls_per_task), "chat_id")
        said = batch_generate(dealt, make_fn, "record", strip, with_columns)
        calls = said.select(F.col("chat_id").alias("digest"), "response", "error")
        # The second version of the committer moves a task's file into place when the task is committed; a task
        # that runs twice has one file, under the same name.
        writer = calls.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        writer.parquet(f"{ledger.rstrip('/')}/run-{uuid.uuid4().hex}")
    answers = state.select(F.col("digest").alias(name), "response", "error")
    rows = asked.select("chat_id", F.col("turn").cast("bigint").alias("turn"), *with_columns, name)
    return rows.join(answers, name).drop(name)
