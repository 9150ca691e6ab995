"""Taking in a folder of chat files again and again, at the cost of what is new.

A ledger notes each file that was taken in: its path, time of change and length. A run lists the folder (no file is
opened for that), leaves out what the ledger has, reads the others and adds them to the table of batches
(``chat_log``) before it notes them. A run that is lost in between takes the same files again, which
leaves the same table.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoframe import schemas
from convoframe.operators.chats import latest
from convoframe.session import materialise
from convoframe.sources.chat_log import SAVED, write_batch

LEDGER = "path string, modificationTime timestamp, length long"
STORED = T.StructType(
    [*schemas.CHAT.fields, T.StructField("source_file", T.StringType()), T.StructField("modified", T.TimestampType())]
)


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return reader.option("recursiveFileLookup", "true").load(folder)


def read_noted(spark: SparkSession, ledger: str) -> DataFrame:
    """The files taken in so far; none if nothing was written yet."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def new_files(
    spark: SparkSession, folder: str, ledger: str, pattern: str = "*.json", listed: DataFrame | None = None
) -> DataFrame:
    """``path, modificationTime, length`` of files that are not in the ledger as they are now (or as ``listed``)."""
    columns = ["path", "modificationTime", "length"]
    every = _files(spark, folder, pattern) if listed is None else listed
    return every.select(*columns).join(read_noted(spark, ledger), columns, "left_anti")


def read_files(
    spark: SparkSession, folder: str, files: DataFrame, pattern: str = "*.json", listed: DataFrame | None = None
) -> DataFrame:
    """The chat documents of ``files`` (of ``new_files``), one row each, as ``read_chats`` gives them, and ``modified``.

    Only files whose time of change lies between the first and the last of ``files`` are opened: Spark's reader
    leaves out the others by their listing. Many small files are read by one task.
    """
    moment = F.unix_micros("modificationTime")
    low, high = files.agg(F.min(moment), F.max(moment)).first()
    every = _files(spark, folder, pattern) if listed is None else listed
    if low is None:
        every = every.where(F.lit(False))
    else:
        every = every.where(F.col("modificationTime").between(*(F.timestamp_micros(F.lit(m)) for m in (low, high))))
    chosen = every.join(files, ["path", "modificationTime", "length"], "left_semi")
    fields = T.StructType([*schemas.CHAT.fields, T.StructField(schemas.CORRUPT, T.StringType())])
    options = {"columnNameOfCorruptRecord": schemas.CORRUPT, "mode": "PERMISSIVE"}
    parsed = F.from_json(F.make_valid_utf8(F.col("content").cast("string")), fields, options)
    rows = chosen.select(
        parsed.alias("chat"), F.col("path").alias("source_file"), F.col("modificationTime").alias("modified")
    ).select("chat.*", "source_file", "modified")
    none = F.lit(0).cast("bigint")
    return rows.withColumns({c: F.coalesce(c, none) for c in ("part", "first_turn")})


def take_in(spark: SparkSession, folder: str, table: str, ledger: str, pattern: str = "*.json") -> DataFrame:
    """Adds the new and changed files of a folder to a table of batches; returns the rows set aside.

    A file holds a whole chat. Of several files of one chat the one changed last wins (``read_taken``), whichever run
    took it in. Files
    that do not parse, or lack the id or the messages, are noted too and come back as rows, as
    ``split_bad_chats`` does: they are read again once they change. Files that were removed change nothing.
    """
    # Listed once a run, as that grows with all files ever saved.
    listed = _files(spark, folder, pattern)
    files = materialise(new_files(spark, folder, ledger, pattern, listed), "new-files")
    rows = materialise(read_files(spark, folder, files, pattern, listed), "taken-in")
    reason = (
        F.when(F.col(schemas.CORRUPT).isNotNull(), "malformed")
        .when(F.col("chat_id").isNull(), "no_chat_id")
        .when(F.col("messages").isNull(), "no_messages")
    )
    marked = rows.withColumn("reason", reason)
    if not files.isEmpty():
        name = uuid.uuid4().hex
        good = marked.where("reason is null").drop("reason", schemas.CORRUPT)
        write_batch(good, table, time.time_ns() // 1_000, run=name)
        files.write.parquet(f"{ledger.rstrip('/')}/run-{name}")
    return marked.where("reason is not null")


def read_taken(spark: SparkSession, table: str) -> DataFrame:
    """The chats taken in, each as its file changed last has it (of files changed at once, that taken in last)."""
    rows = spark.read.schema(T.StructType([*STORED.fields, T.StructField(SAVED, T.LongType())])).parquet(table)
    return latest(rows, ["modified", SAVED, "source_file"], ("chat_id",)).drop(SAVED)
