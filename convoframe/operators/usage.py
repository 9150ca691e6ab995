"""Search over messages, usage numbers, cost and log metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.functions import ids, text
from convoframe.operators.logs import classify_errors, clean_errors
from convoframe.operators.retrieval import search_documents


def search_messages(msgs: DataFrame, q: str, mode: str = "contains") -> DataFrame:
    """Messages with a text in any case, or matching a regular expression."""
    if mode == "contains":
        return msgs.where(F.lower("content").contains(F.lower(F.lit(q))))
    if mode == "regex":
        return msgs.where(F.col("content").rlike(q))
    raise ValueError(f"unknown search mode: {mode}")


def rank_messages(queries: DataFrame, msgs: DataFrame, k: int = 5) -> DataFrame:
    """The best messages per query, ranked as documents are."""
    named = msgs.select(
        F.struct("chat_id", "turn").alias("doc_id"), F.col("content").alias("text")
    )
    hits = search_documents(queries, named, k)
    return hits.select(
        *[c for c in hits.columns if c != "doc_id"],
        F.col("doc_id.chat_id").alias("hit_chat_id"),
        F.col("doc_id.turn").alias("hit_turn"),
    )


def token_counts(msgs: DataFrame, by: tuple[str, ...] = ("chat_id", "role")) -> DataFrame:
    """Tokens (runs of letters and digits) and messages per chat and role."""
    counted = msgs.withColumn("_tokens", F.size(text.tokens(F.coalesce("content", F.lit("")))))
    return counted.groupBy(*by).agg(
        F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("messages")
    )


def estimate_cost(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage (model, tokens, ...)`` priced by the caller's ``prices (model, per_1k)``.

    A model without a price gets a null cost.
    """
    return usage.join(prices, "model", "left").withColumn(
        "cost", F.col("tokens") / 1000 * F.col("per_1k")
    )


def usage_stats(msgs: DataFrame, day: Column | None = None) -> DataFrame:
    """Chats, messages and lengths by day and role, with subtotals (null day, null role).

    The day comes from the chat id unless given. Messages are first counted per chat and role, so
    the distinct chats of a subtotal are counted over chats, not over messages.
    """
    when = ids.chat_day(F.col("chat_id").cast("string")) if day is None else day
    per_chat = msgs.groupBy(when.alias("day"), "chat_id", "role").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.length("content")).alias("_length")
    )
    return per_chat.rollup("day", "role").agg(
        F.count_distinct("chat_id").alias("chats"),
        F.sum("_n").alias("messages"),
        F.sum("_length").alias("chars"),
    )


def log_metrics(log: DataFrame, col: str = "raw", ts: str = "ts", every: str = "1 hour") -> DataFrame:
    """Per time window and error class, the number of rows and the median log length."""
    classed = classify_errors(clean_errors(log, col))
    return (
        classed.groupBy(F.window(ts, every).alias("_window"), "error_type")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.percentile_approx(F.length(col), 0.5).cast("bigint").alias("median_chars"),
        )
        .select(F.col("_window.start").alias("window_start"), "error_type", "n", "median_chars")
    )
