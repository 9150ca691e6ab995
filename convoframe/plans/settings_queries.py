"""Queries over settings changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoframe import schemas
from convoframe.operators import settings
from convoframe.plans.registry import Tables, query

_PROMPT = schemas.DEFAULT_SYSTEM_PROMPT
_THEME = "case when {0} then 'dark' when not {0} then 'light' end"


@query(
    "p5_fill_settings_defaults",
    f"""
    select event_id, coalesce(model, 'gpt-3.5-turbo') as model,
      coalesce(temperature, 0.7::double) as temperature,
      coalesce(system_prompt, '{_PROMPT}') as system_prompt,
      coalesce({_THEME.format("dark_mode")}, 'light') as theme
    from v_settings""",
    ("v_settings",),
)
def p5(t: Tables):
    raw = t.view("v_settings").withColumn(
        "theme", F.when(F.col("dark_mode"), "dark").when(~F.col("dark_mode"), "light")
    )
    return settings.fill_settings_defaults(raw).select(
        "event_id", "model", "temperature", "system_prompt", "theme"
    )


@query(
    "p6_normalise_settings",
    f"""
    select event_id, case when event_type = 'signup' then 'gpt-3.5-turbo'
        when event_type <> 'view' then 'gpt-4' end as model,
      {_THEME.format("value > 10")} as theme
    from events""",
)
def p6(t: Tables):
    raw = t.read("events").select(
        "event_id",
        F.when(F.col("event_type") == "signup", schemas.DEFAULT_MODEL)
        .when(F.col("event_type") != "view", F.col("event_type"))
        .alias("model"),
        (F.col("value") > 10).alias("dark_mode"),
    )
    return settings.normalise_settings(raw).select("event_id", "model", "theme")


@query(
    "p7_validate_settings",
    """
    select event_id, temperature, case when temperature is null then 'missing'
      when not (temperature between 0 and 1) then 'out_of_range' end as reason
    from v_settings""",
    ("v_settings",),
)
def p7(t: Tables):
    return settings.validate_settings(t.view("v_settings")).select("event_id", "temperature", "reason")


def _last(column: str, default: str, window: str) -> str:
    return f"coalesce(last_value({column} ignore nulls) over {window}, {default})"


def _in_force(window: str) -> str:
    theme = _THEME.format("dark_mode")
    return f"""
      {_last("model", "'gpt-3.5-turbo'", window)} as model,
      {_last("temperature", "0.7::double", window)} as temperature,
      {_last("system_prompt", f"'{_PROMPT}'", window)} as system_prompt,
      {_last(theme, "'light'", window)} as theme"""


_VALID = "(temperature is null or temperature between 0 and 1)"
_CHANGES = """partition by session_id order by {} event_id
        rows between unbounded preceding and current row"""


@query(
    "w4_effective_settings",
    f"""
    select session_id, event_id, {_in_force("w")}
    from v_settings where {_VALID} window w as ({_CHANGES.format("ts,")})""",
    ("v_settings",),
)
def w4(t: Tables):
    return settings.effective_settings(t.view("v_settings")).drop("ts")


@query(
    "w5_settings_at",
    f"""
    select session_id, event_id, content, model, temperature, system_prompt, theme from (
      select session_id, event_id, content, is_msg, {_in_force("w")}
      from (
        select session_id, event_id, ts, 0 as is_msg, null as content, model, temperature,
          system_prompt, dark_mode
        from v_settings where {_VALID}
        union all
        select user_id, event_id, ts, 1, props, null, null, null, null from events)
      window w as ({_CHANGES.format("ts, is_msg,")}))
    where is_msg = 1""",
    ("v_settings",),
)
def w5(t: Tables):
    """All events stand for messages of their user's session."""
    asked = t.read("events").select(
        F.col("user_id").alias("session_id"), "ts", "event_id", F.col("props").alias("content")
    )
    return settings.settings_at(asked, t.view("v_settings")).drop("ts")
