"""The chat store: listing, loading, folding, upserting, deleting and naming chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe.functions import ids, text
from convoframe.functions.names import free

# Largest number of messages in one document row, which needs a bound. A chat of any length is one or more
# rows: ``part`` numbers them and ``first_turn`` is the position of a part's first message. Every operator
# and every read takes a chat as all of its parts; a document without these fields is part 0 from turn 0.
FOLD_PART = 10_000


def list_chats(chats: DataFrame, ordered: bool = False) -> DataFrame:
    """``chat_id, chat_name`` of every chat; the messages are never read.

    A chat stored in several parts is listed once, by the least part that it has.
    """
    listing = chats.select("chat_id", "chat_name")
    if "part" in chats.columns:
        least = F.min(F.struct(F.coalesce("part", F.lit(0)).alias("part"), "chat_name")).alias("_first")
        listing = chats.groupBy("chat_id").agg(least).select("chat_id", F.col("_first.chat_name").alias("chat_name"))
    return listing.orderBy("chat_id") if ordered else listing


def load_chat(chats: DataFrame, chat_ids: DataFrame | list[str]) -> DataFrame:
    """The messages of chosen chats as rows; ``turn`` is the position in the chat.

    A list of ids becomes a filter that reaches the scan; a table of ids a semi join.
    """
    if isinstance(chat_ids, DataFrame):
        chosen = chats.join(chat_ids.select("chat_id"), "chat_id", "left_semi")
    else:
        chosen = chats.where(F.col("chat_id").isin(list(chat_ids)))
    return explode_chats(chosen)


def explode_chats(chats: DataFrame) -> DataFrame:
    """Chat documents to message rows."""
    start = F.coalesce("first_turn", F.lit(0)) if "first_turn" in chats.columns else F.lit(0)
    name = [c for c in ("chat_name",) if c in chats.columns]
    rows = chats.select("chat_id", *name, start.alias("_start"), F.posexplode("messages"))
    return rows.select(
        "chat_id",
        *name,
        (F.col("_start") + F.col("pos")).cast("bigint").alias("turn"),
        F.col("col.role").alias("role"),
        F.col("col.content").alias("content"),
    )


def _part(size: int):
    return F.floor(F.col("turn") / size).cast("bigint")


def fold_messages(msgs: DataFrame, part_size: int = FOLD_PART) -> DataFrame:
    """Message rows to chat documents ``chat_id, part, first_turn, messages``.

    A chat of up to ``part_size`` turns is one row, part 0. A longer one is cut into parts, so that
    no task and no row ever holds a whole chat of unknown length; nothing is left out.
    """
    gathered = msgs.groupBy("chat_id", _part(part_size).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("_rows")
    )
    return gathered.select(
        "chat_id",
        "part",
        F.col("_rows")[0]["turn"].alias("first_turn"),
        F.transform(
            "_rows", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))
        ).alias("messages"),
    )


def render_transcript(msgs: DataFrame, fmt: str = "text", part_size: int = FOLD_PART) -> DataFrame:
    """One text per chat (per part of a long chat), messages in order and labelled by role."""
    if fmt == "text":
        label, gap = (lambda role: F.concat(role, F.lit(": "))), "\n"
    elif fmt == "markdown":
        label, gap = (lambda role: F.concat(F.lit("**"), role, F.lit("**\n\n"))), "\n\n"
    else:
        raise ValueError(f"unknown transcript format: {fmt}")

    def line(m):
        return F.concat(label(F.coalesce(m["role"], F.lit(""))), F.coalesce(m["content"], F.lit("")))

    folded = fold_messages(msgs, part_size)
    return folded.select(
        "chat_id", "part", F.array_join(F.transform("messages", line), gap).alias("transcript")
    )


def latest(df: DataFrame, version: list[str], keys: tuple[str, ...]) -> DataFrame:
    """The newest row per key; of a key with parts, all parts of its newest save.

    The newest version of a key is combined before the shuffle and so is the rank limit, so a key that was
    saved very often sends one row per task. Parts of older saves go, also when the chat has shrunk. Of
    rows that tie in key, part and version one stays.
    """
    by = list(keys)
    if "part" in df.columns and "part" not in by:
        save = F.struct(*[F.col(c) for c in version])
        last, theirs = free(df, "_newest"), {c: free(df, f"_key_{c}") for c in by}
        newest = df.groupBy(*by).agg(F.max(save).alias(last)).withColumnsRenamed(theirs)
        same = save.eqNullSafe(F.col(last))
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(theirs[c]))
        df = df.join(newest, same).drop(last, *theirs.values())
        by = [*by, "part"]
    newest = Window.partitionBy(*by).orderBy(*[F.col(c).desc_nulls_last() for c in version])
    rank = free(df, "_rank")
    return df.withColumn(rank, F.row_number().over(newest)).where(F.col(rank) == 1).drop(rank)


def upsert_chats(
    base: DataFrame,
    updates: DataFrame,
    version_col: str | list[str],
    keys: tuple[str, ...] = ("chat_id",),
) -> DataFrame:
    """The last save of a key replaces the whole chat, parts and all. Write the result to a new path."""
    version = [version_col] if isinstance(version_col, str) else list(version_col)
    return latest(base.unionByName(updates, allowMissingColumns=True), version, tuple(keys))


def delete_chats(base: DataFrame, ids_to_delete: DataFrame) -> DataFrame:
    """The chats that are not in the list of ids."""
    return base.join(ids_to_delete.select("chat_id"), "chat_id", "left_anti")


def missing_ids(base: DataFrame, ids_to_delete: DataFrame) -> DataFrame:
    """Ids to delete that no chat has."""
    return (
        ids_to_delete.select("chat_id")
        .distinct()
        .join(base.select("chat_id").distinct(), "chat_id", "left_anti")
    )


def migrate_legacy(df: DataFrame) -> DataFrame:
    """``id``/``name`` documents to ``chat_id``/``chat_name``, without the ``chat_`` prefix."""
    return df.select(
        F.coalesce("chat_id", F.regexp_replace("id", "^chat_", "")).alias("chat_id"),
        F.coalesce("chat_name", "name").alias("chat_name"),
        "messages",
    )


def first_messages(msgs: DataFrame) -> DataFrame:
    """The user message that triggers naming, per chat."""
    return (
        msgs.where("role = 'user'")
        .groupBy("chat_id")
        .agg(F.min("turn").alias("turn"), F.min_by("content", "turn").alias("content"))
    )


def title_chats(msgs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """C11: ``chat_id, chat_name``; a chat without a name is titled from its first message.

    ``names`` holds the present names; a null or empty one counts as absent.
    """
    titled = first_messages(msgs).select("chat_id", text.title(F.col("content")).alias("_title"))
    if names is None:
        return titled.withColumnRenamed("_title", "chat_name")
    # A long chat has several document rows; its name is that of the least part with one.
    part = F.col("part") if "part" in names.columns else F.lit(0)
    name = ids.not_empty(F.col("chat_name"))
    named = names.groupBy("chat_id").agg(F.min_by(name, F.when(name.isNotNull(), part)).alias("_name"))
    return titled.join(named, "chat_id", "left").select(
        "chat_id", F.coalesce("_name", "_title").alias("chat_name")
    )


# What a model is told when it is to name a chat (see ``title_prompts``).
TITLE_INSTRUCTION = (
    "You name chats. From the first message of a chat, give a title of 2 to 5 words for its main "
    "subject, properly capitalized, without special characters or dates."
)


def title_prompts(
    msgs: DataFrame, names: DataFrame | None = None, instruction: str = TITLE_INSTRUCTION
) -> DataFrame:
    """C11 with a model: ``chat_id, turn, prompt`` for each chat without a name, for
    ``batch_generate(..., strip=True)``."""
    first = first_messages(msgs)
    if names is not None:
        named = names.where("chat_name <> ''").select("chat_id").distinct()
        first = first.join(named, "chat_id", "left_anti")
    request = F.concat(F.lit("Give a title for the chat that starts with this message: "), "content")
    return first.select(
        "chat_id",
        "turn",
        F.array(
            F.struct(F.lit("system").alias("role"), F.lit(instruction).alias("content")),
            F.struct(F.lit("human").alias("role"), request.alias("content")),
        ).alias("prompt"),
    )


def check_titles(chats: DataFrame) -> DataFrame:
    """Adds ``reasons``, the parts of the title rule that the name breaks (empty: none)."""
    return chats.withColumn("reasons", text.title_problems(F.col("chat_name")))


def id_collisions(df: DataFrame, key: str = "chat_id") -> DataFrame:
    """A2: ids claimed more than once, with the number of claims."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("claims")).where("claims > 1")
