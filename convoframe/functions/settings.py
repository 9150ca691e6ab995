"""Rules for session settings and message inputs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from convoframe import schemas


def theme(dark_mode: Column) -> Column:
    return F.when(dark_mode, F.lit("dark")).when(~dark_mode, F.lit("light"))


def known_model(model: Column) -> Column:
    """Any model other than the default one is shown, and stored, as the second choice."""
    default = F.lit(schemas.DEFAULT_MODEL)
    return F.when(model == default, default).when(
        model.isNotNull(), F.lit(schemas.OTHER_MODEL)
    )


def temperature_problem(temperature: Column, kind: str = "double") -> Column:
    """Null when valid. A text is no temperature, whatever it says. NaN counts as above 1, as Spark
    orders it."""
    if kind == "string":
        return F.when(temperature.isNull(), "missing").otherwise("not_a_number")
    return F.when(temperature.isNull(), "missing").when(
        ~temperature.cast("double").between(0, 1), "out_of_range"
    )


def message_problem(role: Column, content: Column) -> Column:
    """Null when valid. White space alone is a valid input."""
    return (
        F.when(content.isNull(), "missing_content")
        .when(content == "", "empty_content")
        .when(role.isNull() | ~role.isin(*schemas.ROLES), "unknown_role")
    )
