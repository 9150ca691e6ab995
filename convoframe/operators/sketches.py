"""Mergeable quantile sketches of whole numbers: counts of buckets as wide as a share of their value.

A sketch is a table of (keys, bucket, n). A bucket is named by its least number in size: the value with all but
its ``bits + 1`` leading binary digits set to zero. Sketches of parts are merged by adding counts, in any order and
grouping, to exactly the sketch of the whole. A key has at most 64 * 2^bits buckets of either sign, whatever its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoframe.functions.names import free

BITS = 7


def bucket_of(value: Column, bits: int = BITS) -> Column:
    """The bucket of a whole number: no further from it than 2^-bits of it, towards zero."""
    size = F.abs(value.cast("bigint"))
    shift = F.greatest(F.length(F.bin(size)) - (bits + 1), F.lit(0))
    low = F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)
    return F.when(value < 0, -low).otherwise(low)


def quantile_sketch(df: DataFrame, keys: dict[str, Column], value: Column, bits: int = BITS) -> DataFrame:
    """``*keys, bucket, n`` of a table; null values are in no bucket. Counts combine before the shuffle."""
    made = df.select(*(c.alias(name) for name, c in keys.items()), bucket_of(value, bits).alias("bucket"))
    return made.where("bucket is not null").groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketches: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Sketches under new ``keys`` (such as the day of an hour): the counts of their buckets, added."""
    named = sketches.select(*(c.alias(name) for name, c in keys.items()), "bucket", "n")
    return named.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantiles(sketch: DataFrame, keys: tuple[str, ...], shares: dict[str, float]) -> DataFrame:
    """``*keys, n`` and, for each name in ``shares`` (above 0, at most 1), the bucket that holds the value of rank
    ceil(share * n): that value lies less than 2^-bits of itself beyond it, and no rank is wrong by more than what
    shares its bucket. Each key's few buckets meet in one window."""
    upto, every = free(sketch, "upto"), free(sketch, "every")
    whole = Window.partitionBy(*keys)
    run = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sketch.withColumns({upto: F.sum("n").over(run), every: F.sum("n").over(whole)})
    reached = {name: F.col(upto) >= F.ceil(F.lit(share) * F.col(every)) for name, share in shares.items()}
    return ranked.groupBy(*keys).agg(
        F.sum("n").alias("n"), *(F.min(F.when(there, F.col("bucket"))).alias(name) for name, there in reached.items())
    )
