import random

import pytest

from convoframe import schemas
from convoframe.operators import settings

EVENTS = (
    "session_id string, event_id bigint, ts timestamp_ntz, model string, temperature double, "
    "system_prompt string, dark_mode boolean"
)
DEFAULTS = (schemas.DEFAULT_MODEL, 0.7, schemas.DEFAULT_SYSTEM_PROMPT, "light")


def test_defaults(spark, rows):
    df = spark.createDataFrame(
        [(1, None, None, None, None), (2, "gpt-4", 0.0, "", "dark")],
        "id int, model string, temperature double, system_prompt string, theme string")
    assert rows(settings.fill_settings_defaults(df)) == [
        (1, *DEFAULTS), (2, "gpt-4", 0.0, "", "dark")]


def test_normalise(spark, rows):
    df = spark.createDataFrame(
        [("gpt-3.5-turbo", True), ("gpt-4", False), ("something", None), (None, None)],
        "model string, dark_mode boolean")
    assert [tuple(r) for r in settings.normalise_settings(df).collect()] == [
        ("gpt-3.5-turbo", "dark"), ("gpt-4", "light"), ("gpt-4", None), (None, None)]


def test_temperature(spark):
    """also -0.0 and a whole number."""
    values = [0.0, 1.0, -1.0, 2.0, float("nan"), None, -0.0, 0.5]
    df = spark.createDataFrame([(v,) for v in values], "temperature double")
    assert [r.reason for r in settings.validate_settings(df).collect()] == [
        None, None, "out_of_range", "out_of_range", "out_of_range", "missing", None, None]


def test_a_text_is_no_temperature(spark):
    df = spark.createDataFrame([("0.5",), (None,)], "temperature string")
    assert [r.reason for r in settings.validate_settings(df).collect()] == ["not_a_number", "missing"]


def test_partial_updates(spark, at):
    events = spark.createDataFrame(
        [
            ("s", 1, at(1), "gpt-4", 0.5, "New prompt", True),
            ("s", 2, at(2), None, 0.3, None, None),
            ("s", 3, at(3), "lost", 2.0, "lost", False),  # F8: refused as a whole
            ("s", 4, at(4), None, None, "Other", None),
            ("t", 5, at(0), None, None, None, None),
        ], EVENTS)
    found = {r.event_id: tuple(r)[3:] for r in settings.effective_settings(events).collect()}
    assert found == {
        1: ("gpt-4", 0.5, "New prompt", "dark"),
        2: ("gpt-4", 0.3, "New prompt", "dark"),
        4: ("gpt-4", 0.3, "Other", "dark"),
        5: DEFAULTS,
    }


def brute_force(changes, asked):
    """Settings after each change, and at each message, one row at a time."""
    order = sorted(
        [(s, t is not None, t, 0, e, values) for s, e, t, *values in changes]
        + [(s, t is not None, t, 1, e, None) for s, e, t in asked],
        key=lambda x: (x[0], x[1], x[2] or 0, x[3], x[4]))
    now: dict = {}
    after, seen = {}, {}
    for s, _, t, _, e, values in order:
        state = now.setdefault(s, list(DEFAULTS))
        if values is None:
            seen[e] = tuple(state)
            continue
        model, temperature, prompt, dark = values
        if temperature is not None and not 0 <= temperature <= 1:
            continue
        for place, value in enumerate((model, temperature, prompt, dark)):
            if value is not None:
                state[place] = ("dark" if value else "light") if place == 3 else value
        after[e] = tuple(state)
    return after, seen


@pytest.mark.parametrize("limit", [40, 5, 1])
def test_hot_sessions_do_not_change_results(spark, at, limit):
    """One session holds most events, many at one instant; many ranges cut it into blocks."""
    rng = random.Random(limit)

    def maybe(value):
        return value if rng.random() < 0.3 else None

    changes = [
        ("hot" if rng.random() < 0.7 else f"s{rng.randrange(9)}", e, at(rng.choice([7, rng.randrange(500)])),
         maybe(f"m{e}"), maybe(rng.choice([0.1, 0.9, 1.5])), maybe(f"p{e}"), maybe(rng.random() < 0.5))
        for e in range(300)
    ]
    changes += [("hot", 1000, None, "first", None, None, None)]
    asked = [("hot" if rng.random() < 0.7 else f"s{rng.randrange(9)}", e, at(rng.randrange(500)))
             for e in range(2000, 2100)]
    after, seen = brute_force(changes, asked)
    changed = spark.createDataFrame(changes, EVENTS)
    found = settings.effective_settings(changed, partitions=limit).collect()
    assert {r.event_id: tuple(r)[3:] for r in found} == after
    msgs = spark.createDataFrame(asked, "session_id string, event_id bigint, ts timestamp_ntz")
    found = settings.settings_at(msgs, changed, partitions=limit).collect()
    assert {r.event_id: tuple(r)[3:] for r in found} == seen
