"""Session settings: defaults, validation, effective values over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe import schemas
from convoframe.functions import settings as rules
from convoframe.operators.blocks import Blocks

_SETTINGS = ("model", "temperature", "system_prompt", "theme")
_DEFAULTS = {
    "model": schemas.DEFAULT_MODEL,
    "temperature": schemas.DEFAULT_TEMPERATURE,
    "system_prompt": schemas.DEFAULT_SYSTEM_PROMPT,
    "theme": schemas.DEFAULT_THEME,
}


def fill_settings_defaults(df: DataFrame) -> DataFrame:
    """P5: null settings take the session defaults; columns that are not settings pass through."""
    present = [c for c in _SETTINGS if c in df.columns]
    return df.withColumns({c: F.coalesce(c, F.lit(_DEFAULTS[c])) for c in present})


def normalise_settings(df: DataFrame) -> DataFrame:
    """``dark_mode`` becomes ``theme``; a model is one of the two on offer. Null stays null."""
    return df.withColumns(
        {"model": rules.known_model(F.col("model")), "theme": rules.theme(F.col("dark_mode"))}
    ).drop("dark_mode")


def validate_settings(df: DataFrame) -> DataFrame:
    """Adds ``reason``, null when the temperature is valid."""
    return df.withColumn("reason", _problem(df))


def _problem(df: DataFrame):
    return rules.temperature_problem(F.col("temperature"), dict(df.dtypes)["temperature"])


def accepted_changes(events: DataFrame) -> DataFrame:
    """Changes that take effect: an invalid temperature refuses the whole event, and an absent one
    means "not changed"."""
    return events.where(F.coalesce(_problem(events), F.lit("missing")) == "missing")


def _with_theme(events: DataFrame) -> DataFrame:
    if "dark_mode" not in events.columns:
        return events
    return events.withColumn("theme", rules.theme(F.col("dark_mode"))).drop("dark_mode")


def _last_known(
    df: DataFrame, keys: list[str], ts: str, order: list[str], partitions: int | None
) -> DataFrame:
    """Each setting's last non-null value up to and including the row."""
    blocks = Blocks(df, keys, [F.col(c) for c in (ts, *order)], partitions)
    sequence = F.struct(ts, *order)
    so_far = Window.partitionBy(*blocks.by).orderBy(ts, *order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    rows = blocks.rows.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in _SETTINGS})
    closing = blocks.rows.groupBy(*blocks.by).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), sequence)).alias(c) for c in _SETTINGS]
    )
    earlier = Window.partitionBy(*keys).orderBy(blocks.block).rowsBetween(Window.unboundedPreceding, -1)
    carry = closing.select(
        *blocks.by, *[F.last(c, ignorenulls=True).over(earlier).alias(f"_{c}") for c in _SETTINGS]
    )
    return (
        blocks.with_carry(rows, carry)
        .withColumns({c: F.coalesce(c, f"_{c}") for c in _SETTINGS})
        .drop(blocks.block, *[f"_{c}" for c in _SETTINGS])
    )


def effective_settings(
    events: DataFrame,
    session: str = "session_id",
    ts: str = "ts",
    tie: str = "event_id",
    partitions: int | None = None,
) -> DataFrame:
    """The settings in force after each accepted change, starting from the defaults."""
    changes = _with_theme(accepted_changes(events))
    known = _last_known(changes, [session], ts, [tie], partitions)
    return fill_settings_defaults(known).select(session, tie, ts, *_SETTINGS)


def settings_at(
    msgs: DataFrame,
    settings: DataFrame,
    session: str = "session_id",
    ts: str = "ts",
    tie: str = "event_id",
    partitions: int | None = None,
) -> DataFrame:
    """The settings in force when each message arrives.

    Both inputs become one ordered sequence, so the look-back needs no range join. At the same
    instant a change comes before a message.
    """
    changes = _with_theme(accepted_changes(settings)).select(session, ts, tie, *_SETTINGS)
    extra = [c for c in msgs.columns if c not in (session, ts, tie, *_SETTINGS)]
    both = changes.withColumn("_is_msg", F.lit(False)).unionByName(
        msgs.select(session, ts, tie, *extra).withColumn("_is_msg", F.lit(True)),
        allowMissingColumns=True,
    )
    known = _last_known(both, [session], ts, ["_is_msg", tie], partitions)
    return fill_settings_defaults(known.where("_is_msg")).select(
        session, ts, tie, *extra, *_SETTINGS
    )
