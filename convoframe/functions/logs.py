"""Rules for command logs and app status."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoframe.functions.text import strip

# A log line holding one of these (as written) is noise.
NOISE = (
    "urllib3",
    "NotOpenSSLWarning",
    "LibreSSL",
    "warnings.warn",
    "CLI v0.",
    "found at",
    "$PATH prefers",
    "assume you are trying",
    "disable this behavior",
    "Executing CLI",
    "-------------------------",
)
VERSION_NOISE = "CLI v0."

# A line holding one of these (in any case) reports an error.
ERROR_WORDS = ("error", "failed", "limit", "permission", "not found", "invalid")

# A line end with the white space around it; blank lines fall away, and never matter.
_LINE_END = r"(?U)[\s\x{1c}-\x{1f}&&[^\n]]*\n[\s\x{1c}-\x{1f}]*"

EMPTY_LOG = "Unknown error occurred"


def _any_of(substrings) -> str:
    return "|".join(re.escape(s) for s in substrings)


def log_lines(raw: Column) -> Column:
    return F.split(strip(raw), _LINE_END)


def error_lines(lines: Column) -> Column:
    """The lines that report errors and are not noise."""
    return F.filter(
        lines,
        lambda line: F.lower(line).rlike(_any_of(ERROR_WORDS)) & ~line.rlike(_any_of(NOISE)),
    )


def message(raw: Column, lines: Column, errors: Column) -> Column:
    """The error lines of a log, else its last readable line, else the log itself."""
    readable = F.filter(lines, lambda line: (line != "") & ~line.contains(VERSION_NOISE))
    last_readable = F.try_element_at(readable, F.lit(-1))
    return (
        F.when(raw.isNull() | (raw == ""), F.lit(EMPTY_LOG))
        .when(F.size(errors) > 0, F.array_join(errors, "\n"))
        .otherwise(F.coalesce(last_readable, raw))
    )


def error_type(message: Column) -> Column:
    """First matching class wins."""
    text = F.lower(message)
    return (
        F.when(text.contains("max limit") & text.contains("scope"), "Workspace Limit Reached")
        .when(text.contains("permission") | text.contains("access"), "Permission Error")
        .when(text.contains("not found"), "Resource Not Found")
        .when(text.contains("invalid") | text.contains("bad request"), "Invalid Request")
        .otherwise("Error")
    )


def health(app_state: Column, compute_state: Column) -> Column:
    starting = ("PENDING", "STARTING")
    app = F.coalesce(app_state, F.lit("Unknown"))
    compute = F.coalesce(compute_state, F.lit("Unknown"))
    return (
        F.when((app == "RUNNING") & (compute == "ACTIVE"), "Healthy")
        .when(app.isin(*starting) | compute.isin(*starting), "Starting")
        .otherwise("Issue Detected")
    )


def already_up(app_state: Column, compute_state: Column) -> Column:
    """The looser test made before a start: either side being up is enough."""
    return F.coalesce(compute_state == "ACTIVE", F.lit(False)) | F.coalesce(
        app_state == "RUNNING", F.lit(False)
    )


def elapsed_text(seconds: Column) -> Column:
    whole = seconds.cast("bigint")
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(minutes, F.lit("m "), (whole % 60).cast("string"), F.lit("s elapsed"))


_JSON_ENDS = r"(?s)\A\s*(\{.*\}|\[.*\]|\".*\"|[-0-9tfn][^\s]*)\s*\z"
_SENTINEL = "\\u241Eend-of-text\\u241E"


def is_json(raw: Column) -> Column:
    """Whether a text is exactly one JSON value.

    Spark's parser stops after the first value and ignores what follows, so the text is parsed as
    the first of two array elements: anything that follows the value breaks the array.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f',"{_SENTINEL}"]')))
    alone = F.try_variant_get(wrapped, "$[1]", "string") == json.loads(f'"{_SENTINEL}"')
    # A failed parse is slow, so texts that cannot be JSON by their ends are not tried.
    plausible = raw.rlike(_JSON_ENDS) & ~raw.contains("end-of-text")
    return F.when(plausible, alone).otherwise(F.lit(False))


_STRUCTURE = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
_CLOSES = {"}": "{", "]": "["}


def _is_valid(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        # A value nested deeper than the parser goes counts as none.
        return False
    return True


def _first_balanced(text: str) -> str | None:
    """The JSON text from the first brace (else bracket) to the one that closes it."""
    starts = [at for at in (text.find("{"), text.find("[")) if at >= 0]
    if not starts:
        return None
    open_marks: list[str] = []
    quoted = False
    for found in _STRUCTURE.finditer(text, starts[0]):
        mark = found.group()
        if mark == '"':
            quoted = not quoted
        elif quoted or len(mark) > 1:
            continue
        elif mark in "{[":
            open_marks.append(mark)
        elif open_marks[-1] == _CLOSES[mark]:
            open_marks.pop()
            if not open_marks:
                whole = text[starts[0] : found.end()]
                return whole if _is_valid(whole) else None
    return None


@F.pandas_udf(T.StringType())
def _scan_json(raw: pd.Series) -> pd.Series:
    return raw.map(
        lambda text: None if text is None else text if _is_valid(text) else _first_balanced(text)
    )


def scanned_json(raw: Column, direct: Column) -> Column:
    """The JSON text found by scanning. Only texts that failed the direct parse and may still hold
    JSON are sent to Python."""
    return _scan_json(F.when(~direct & raw.rlike(r"[{\[]|NaN|Infinity"), raw))
