"""Column names that a caller's table does not have."""

from pyspark.sql import DataFrame


def free(df: DataFrame, name: str, *others: DataFrame) -> str:
    """``name``, with underscores before it until no column of the tables is called so in any case of letters."""
    taken = {c.lower() for table in (df, *others) for c in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
