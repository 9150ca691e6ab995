"""Named items and grants on them: existence, permission, tiers, capped selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe.functions.names import free
from convoframe.session import materialise

# Fixed value: items whose lower-cased name begins so form the first tier.
PRIORITY_PREFIX = "shared"


def is_priority(name):
    return F.lower(name).startswith(PRIORITY_PREFIX)


def exists_in(requests: DataFrame, catalog: DataFrame, key: str = "name") -> DataFrame:
    """Adds ``found``, whether the requested key is in the catalog.

    The catalog's keys are written, so that Spark may split a key that very many requests have in the join.
    """
    mark = free(requests, "_present")
    present = materialise(catalog.select(key).distinct().withColumn(mark, F.lit(True)), "catalog-keys")
    return requests.join(present, key, "left").withColumn("found", F.col(mark).isNotNull()).drop(mark)


def manageable(
    items: DataFrame, grants: DataFrame, perm: str = "MANAGE", any_principal: bool = False
) -> DataFrame:
    """The items on which their owner (or, loosely, anybody) holds the permission.

    The grants that count are written, so that Spark may split very many items of one name in the join.
    """
    held = grants.where(F.col("permission") == perm)
    if any_principal:
        names = materialise(held.select("name").distinct(), "granted-names")
        return items.join(names, "name", "left_semi")
    pairs = materialise(held.select("name", F.col("principal").alias("owner")).distinct(), "grants")
    return items.join(pairs, ["name", "owner"], "left_semi")


def tier_counts(items: DataFrame, by: str = "owner") -> DataFrame:
    """A1: first-tier items and all items per owner."""
    return items.groupBy(by).agg(
        F.count_if(is_priority(F.col("name"))).alias("n_shared"), F.count(F.lit(1)).alias("n")
    )


def first_tier(items: DataFrame, ordered: bool = False) -> DataFrame:
    """A1: the first-tier items themselves; ``ordered`` sorts them by name."""
    found = items.where(is_priority(F.col("name")))
    return found.orderBy("name") if ordered else found


def prioritised_fill(
    items: DataFrame, cap: int = 20, by: str = "owner", ordered: bool = False
) -> DataFrame:
    """Per owner, all first-tier items, then the others by name until ``cap`` is reached.

    Filter by permission before. Only the second tier is ranked, and its limit also runs before the
    shuffle; the first tier, which has no limit, is only counted. ``ordered`` sorts the result by
    owner, tier and lower-cased name. The tier's column is ``tier``, or ``_tier`` where the items have one.
    """
    tier, rank, taken = (free(items, name) for name in ("tier", "_rank", "_used"))
    tiers = items.withColumn(tier, F.when(is_priority(F.col("name")), 0).otherwise(1).cast("bigint"))
    first = tiers.where(F.col(tier) == 0)
    used = first.groupBy(by).agg(F.count(F.lit(1)).alias(taken))
    by_name = Window.partitionBy(by).orderBy("name")
    others = tiers.where(F.col(tier) == 1).withColumn(rank, F.row_number().over(by_name))
    fill = (
        others.where(F.col(rank) <= cap)
        .join(used, by, "left")
        .where(F.col(rank) <= cap - F.coalesce(taken, F.lit(0)))
        .drop(rank, taken)
    )
    chosen = first.unionByName(fill)
    return chosen.orderBy(by, tier, F.lower("name"), "name") if ordered else chosen
