"""Cutting keys into blocks, so that an ordered pass over one key never runs in one task.

An ordered window ``partitionBy(key)`` puts all rows of a key into one task. Here the rows are dealt out by
ranges of (key, order) whatever the keys' sizes, and written with the number of their range. The window
runs per ``(key, block)``, each block hands its state on as one row, and the state that enters a block is
joined back. A key of any size, null included, and a burst of rows at one instant are spread alike; a small
key lies in one block, or two where a range ends in it.

The cut only spreads the work: the result does not depend on where it lies.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.functions.names import free
from convoframe.session import materialise


class Blocks:
    """Rows with the number of their block; blocks of a key are numbered in its order.

    ``order`` should leave no ties, else rows that tie may lie on both sides of a cut. ``partitions`` sets the
    number of ranges; by default the session's shuffle partitions, which AQE merges where they are small.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column], partitions: int | None = None):
        self.keys = list(keys)
        # A name that the rows do not use.
        self.block = free(df, "_block")
        self.by = [*self.keys, self.block]
        cuts = [*[F.col(k) for k in self.keys], *order]
        dealt = df.repartitionByRange(partitions, *cuts) if partitions else df.repartitionByRange(*cuts)
        # Written once: a number that is computed again might differ.
        self.rows = materialise(dealt.withColumn(self.block, F.spark_partition_id()), "blocks")

    def with_carry(self, rows: DataFrame, carry: DataFrame) -> DataFrame:
        """Add to each row the state that enters its block: ``carry`` has one row per (key, block)."""
        theirs = {c: free(rows, f"_carry_{c}", carry) for c in self.by}
        same = [F.col(c).eqNullSafe(F.col(theirs[c])) for c in self.by]
        joined = rows.join(carry.withColumnsRenamed(theirs), functools.reduce(operator.and_, same), "left")
        return joined.drop(*theirs.values())
