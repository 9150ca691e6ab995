"""Messages saved as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from convoframe.operators.chats import latest
from convoframe.sources import chat_log

KEYS = ("chat_id", "turn")


def stream_autosave(
    msg_stream: DataFrame,
    path: str,
    checkpoint: str,
    version: tuple[str, ...] = (),
    available_now: bool = False,
) -> StreamingQuery:
    """Save each micro-batch of messages as one batch of a chat table, keyed by chat and turn.

    A batch that is repeated after a failure replaces itself. The run is the stream's own id, which its
    checkpoint keeps, so a stream with another checkpoint adds to the table and replaces nothing.
    ``version`` names the columns that order several saves of one message within a micro-batch; without it,
    a micro-batch that saves a message twice ends the stream.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        if version:
            rows = latest(batch, list(version), KEYS)
        else:
            rows = batch
            twice = batch.groupBy(*KEYS).count().where("count > 1")
            if not twice.isEmpty():
                raise ValueError("a message is saved twice in one micro-batch: name its version columns")
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        chat_log.write_batch(rows, path, batch_id, run)

    writer = msg_stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_autosave(spark: SparkSession, path: str, schema, version: tuple[str, ...] = ()) -> DataFrame:
    """The saved messages: the newest row per chat and turn."""
    return chat_log.read_current(spark, path, schema, KEYS, version)
