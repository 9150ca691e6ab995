"""Ordered messages: validation, question and reply, history, prompts, appended replies.

``turn`` is a message's position in its chat. Positions are unique within a chat; ``number_turns``
restores them after rows were filtered out. Every operator here groups by a bounded range of
positions, never by a whole chat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe import schemas
from convoframe.functions import settings as rules
from convoframe.functions.names import free
from convoframe.operators.blocks import Blocks
from convoframe.session import materialise

# Positions per group when looking at neighbours.
PAIR_PART = 100_000
# Positions per group when gathering histories.
CONTEXT_PART = 1_000


def _range(size: int):
    """The number of the range of positions that a message is in."""
    return F.floor(F.col("turn") / size).cast("bigint")


def validate_messages(msgs: DataFrame) -> DataFrame:
    """Adds ``reason``, null when the message is valid."""
    return msgs.withColumn("reason", rules.message_problem(F.col("role"), F.col("content")))


def number_turns(
    msgs: DataFrame, order: str = "turn", tie: str | None = None, partitions: int | None = None
) -> DataFrame:
    """Renumber each chat's messages 0, 1, 2, ... in the given order; ``tie`` orders equal ones."""
    by = [order, tie] if tie else [order]
    blocks = Blocks(msgs, ["chat_id"], [F.col(c) for c in by], partitions)
    within = Window.partitionBy(*blocks.by).orderBy(*by)
    earlier = Window.partitionBy("chat_id").orderBy(blocks.block).rowsBetween(Window.unboundedPreceding, -1)
    at, before = free(msgs, "_at"), free(msgs, "_before")
    sizes = blocks.rows.groupBy(*blocks.by).agg(F.count(F.lit(1)).alias("_n"))
    carry = sizes.select(*blocks.by, F.sum("_n").over(earlier).alias(before))
    rows = blocks.rows.withColumn(at, F.row_number().over(within))
    place = F.col(at) - 1 + F.coalesce(before, F.lit(0))
    others = [c for c in msgs.columns if c != "turn"]
    return blocks.with_carry(rows, carry).select(*others, place.cast("bigint").alias("turn"))


def pair_turns(msgs: DataFrame, part_size: int = PAIR_PART) -> DataFrame:
    """Every user message with the assistant reply at the next position, else a null reply.

    Rows are grouped by ranges of positions. A reply that opens a range is also copied to the range
    before it, where its question is.
    """
    part = _range(part_size)
    opens_range = (F.col("turn") % part_size == 0) & (F.col("role") == "assistant")
    parts = F.when(opens_range, F.array(part, part - 1)).otherwise(F.array(part))
    rows = msgs.where(F.col("role").isin("user", "assistant")).select(
        "chat_id", "turn", "role", "content", F.explode(parts).alias("_part")
    )
    following = Window.partitionBy("chat_id", "_part").orderBy("turn")
    nxt = F.lead(F.struct("turn", "role", "content")).over(following)
    answered = (F.col("_next.turn") == F.col("turn") + 1) & (F.col("_next.role") == "assistant")
    return (
        rows.withColumn("_next", nxt)
        .where("role = 'user'")
        .select(
            "chat_id",
            "turn",
            F.col("content").alias("question"),
            F.when(answered, F.col("_next.turn")).alias("reply_turn"),
            F.when(answered, F.col("_next.content")).alias("reply"),
        )
    )


def _with_history(msgs: DataFrame, max_turns: int | None, part_size: int) -> DataFrame:
    """User messages with ``_history``, the messages before them, all or up to ``max_turns`` positions back.

    Rows are grouped by ranges of positions. With a bound, a range also gets the rows of the one before it
    that its first messages look back to. Without one, a range gets all rows before it, gathered once;
    the histories are that large anyway, as the caller asked for all of it.
    """
    size = part_size if max_turns is None else max(part_size, max_turns)
    own = _range(size)
    spoken = F.struct("role", "content")
    ordered = Window.partitionBy("chat_id", "_part").orderBy("turn")
    if max_turns is not None:
        last = F.floor((F.col("turn") + max_turns) / size).cast("bigint")
        parts = F.when(last > own, F.array(own, last)).otherwise(F.array(own))
        rows = msgs.withColumn("_own", own).withColumn("_part", F.explode(parts))
        if max_turns:
            near = F.collect_list(spoken).over(ordered.rangeBetween(-max_turns, -1))
        else:
            near = F.array().cast("array<struct<role:string,content:string>>")
        rows = rows.withColumn("_history", near).where("_own = _part and role = 'user'")
        return rows.drop("_own", "_part")
    placed = msgs.withColumn("_part", own)
    within = F.collect_list(spoken).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    users = placed.withColumn("_within", within).where("role = 'user'")
    # Rows travel to later ranges in which a user asks; a chat of one range sends none.
    asked = placed.where("role = 'user' and _part > 0").select(F.col("chat_id").alias("_chat"), F.col("_part").alias("_to"))
    # Written, so that Spark may split a busy chat's rows in the join.
    last = materialise(asked.groupBy("_chat").agg(F.max("_to").alias("_last")), "last-ranges")
    earlier = placed.join(last, (F.col("chat_id") == F.col("_chat")) & (F.col("_part") < F.col("_last")))
    sent = earlier.select(
        "_chat", "turn", "role", "content", F.explode(F.sequence(F.col("_part") + 1, "_last")).alias("_to")
    )
    gathered = sent.groupBy("_chat", "_to").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_before")
    )
    before = F.transform("_before", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    joined = users.join(gathered, (F.col("chat_id") == F.col("_chat")) & (F.col("_part") == F.col("_to")), "left")
    history = F.when(F.col("_before").isNull(), F.col("_within")).otherwise(F.concat(before, "_within"))
    return joined.withColumn("_history", history).drop("_chat", "_to", "_before", "_within", "_part")


def build_context(
    msgs: DataFrame, max_turns: int | None = None, part_size: int = CONTEXT_PART
) -> DataFrame:
    """The messages before each user turn: ``chat_id, turn, content, history``.

    ``max_turns=k`` keeps the previous k positions. Without it the history is all earlier messages of
    the chat, whose total grows with the square of a chat's length; give a bound for very long chats.
    ``part_size`` only spreads the work.
    """
    talk = msgs.select("chat_id", "turn", "role", "content")
    return _with_history(talk, max_turns, part_size).select(
        "chat_id", "turn", "content", F.col("_history").alias("history")
    )


def _system_prompts(msgs: DataFrame, settings: DataFrame | None) -> DataFrame:
    """``chat_id, _system``: the chat's own opening system row, else its session's prompt."""
    own = msgs.where("role = 'system' and turn = 0").select(
        "chat_id", F.lit(0).alias("_choice"), F.col("content").alias("_system")
    )
    if settings is not None:
        own = own.unionByName(
            settings.where("system_prompt is not null").select(
                "chat_id", F.lit(1).alias("_choice"), F.col("system_prompt").alias("_system")
            )
        )
    # Written, so that Spark may split a busy chat's rows in the join to it.
    return materialise(own.groupBy("chat_id").agg(F.min_by("_system", "_choice").alias("_system")), "system-prompts")


def build_prompts(
    msgs: DataFrame,
    settings: DataFrame | None = None,
    max_turns: int | None = None,
    part_size: int = CONTEXT_PART,
) -> DataFrame:
    """``chat_id, turn, prompt`` for each user turn; the prompt is system, history, human.

    The system prompt is the chat's opening system row, else the chat's row in ``settings``
    (``chat_id, system_prompt``), else the message's own ``system_prompt`` column if there is one,
    else the default. System rows are no part of the history; rows without a role are. ``model`` and
    ``temperature`` columns of the messages (W5) are passed on. See ``build_context`` for ``max_turns``.
    """
    none = F.lit(None).cast("string")
    own_prompt = F.col("system_prompt") if "system_prompt" in msgs.columns else none
    passed = [c for c in ("model", "temperature") if c in msgs.columns]
    talk = msgs.select("chat_id", "turn", "role", "content", own_prompt.alias("system_prompt"), *passed)
    users = _with_history(talk.where("role is null or role <> 'system'"), max_turns, part_size)
    users = users.join(_system_prompts(talk, settings), "chat_id", "left")
    system = F.coalesce("_system", "system_prompt", F.lit(schemas.DEFAULT_SYSTEM_PROMPT))

    def message(role, content):
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    return users.select(
        "chat_id",
        "turn",
        *passed,
        F.concat(message("system", system), "_history", message("human", F.col("content"))).alias("prompt"),
    )


def append_responses(
    msgs: DataFrame, responses: DataFrame, partitions: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(messages, rejected)``: the chats with each answer after the user turn it answers, renumbered.

    ``responses`` are the rows of ``batch_generate`` (``chat_id, turn, response, error``). Rejected, with a
    ``reason``, are rows with an error or without a response (``failed``), rows whose chat has no such user
    turn (``unknown_turn``), and further answers to one turn (``repeated``; the least text stays).
    """
    turns = msgs.where("role = 'user'").select("chat_id", "turn").distinct().withColumn("_known", F.lit(True))
    first = Window.partitionBy("chat_id", "turn", "_failed").orderBy("response")
    failed = F.col("response").isNull() | F.col("error").isNotNull()
    judged = (
        responses.select("chat_id", "turn", "response", "error")
        .withColumn("_failed", failed)
        .withColumn("_rank", F.row_number().over(first))
        .join(turns, ["chat_id", "turn"], "left")
    )
    reason = (
        F.when(F.col("_failed"), "failed").when(F.col("_known").isNull(), "unknown_turn").when(F.col("_rank") > 1, "repeated")
    )
    judged = judged.withColumn("reason", reason)
    replies = judged.where("reason is null").select(
        "chat_id", "turn", F.lit("assistant").alias("role"), F.col("response").alias("content"), F.lit(1).alias("_after")
    )
    both = msgs.select("chat_id", "turn", "role", "content", F.lit(0).alias("_after")).unionByName(replies)
    numbered = number_turns(both, "turn", "_after", partitions)
    rejected = judged.where("reason is not null").select("chat_id", "turn", "response", "error", "reason")
    return numbered.select("chat_id", "turn", "role", "content"), rejected
