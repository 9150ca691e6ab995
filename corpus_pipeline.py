"""A corpus pipeline over ``documents``: each stage works on all that its predecessor kept.

In every stage null texts count as empty, null and repeated ids are rows of their own, texts may have any
length, an empty table gives an empty table, and further columns, whatever their names, are passed on (by the
last stage left out). Of rows that tie for staying, one stays.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.llm.common import bound_batches, table
from convoframe.llm.cuckoo import exact_duplicates
from convoframe.llm.decontaminate import contaminated
from convoframe.llm.near_dup import near_duplicates
from convoframe.llm.pieces import encode_and_decode
from convoframe.llm.queries import PIECES, vocabulary
from convoframe.llm.toxicity import fit_toxicity, toxicity_scores
from convoframe.session import materialise, release, scratch_paths

# Dropped rows whose numbers may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
TOXIC = 0.3


def _without(docs: DataFrame, dropped: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``docs`` without the rows that ``dropped`` gives, by a number of its own for each row.

    The numbers are written with the rows, so that null and repeated ids do no harm.
    """
    row = "row"
    while row in docs.columns:
        row = f"_{row}"
    numbered = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    out = materialise(dropped(numbered, row).select(row), "dropped")
    if out.count() <= BROADCAST_ROWS:
        out = F.broadcast(out)
    return numbered.join(out, row, "left_anti").select(docs.columns)


# Scratch tables of the stage that ran last.
_last: list[str] = []


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes the scratch tables of the one before, whose result has been written and is
    read again as ``docs``. What ``docs`` itself reads stays."""

    @functools.wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, _last, keep=docs)
        bound_batches(spark)
        with scratch_paths() as made:
            kept = work(spark, docs, sf_dir)
        _last[:] = made
        return kept

    return run_stage


@_stage
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches 0.3 go."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, lambda rows, row: toxicity_scores(rows, model, row).where(F.col("score") >= TOXIC))


@_stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for their white space, the row with the smallest doc_id stays."""
    return _without(docs, lambda rows, row: exact_duplicates(rows, row=row).where("not kept"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by 0.8 or more of their five-word shingles, one document stays."""
    return _without(
        docs, lambda rows, row: near_duplicates(rows, shingle=5, percent=80, rows=7, row=row).where("not kept")
    )


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten words of a benchmark item in a row (or all of a shorter one) go."""
    items = table(spark, sf_dir, "benchmark")
    return _without(docs, lambda rows, row: contaminated(rows, items, row=row).where("contaminated"))


@_stage
def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of the whole text, the text they decode to, and whether it is the text encoded."""
    file = vocabulary(PIECES)
    same = F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    found = encode_and_decode(docs.select(same.alias("row"), "text"), file, key="row")
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        "ids",
        "text",
        (F.sha2("text", 256) == F.col("row.sha")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("sentencepiece", sentencepiece),
]

# A fitted classifier and a model's best paths have no SQL; a test compares run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
