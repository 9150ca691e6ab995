import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from convoframe.operators.blocks import Blocks


@pytest.fixture
def crowded(spark, at):
    """A key with most rows at one instant, a null key, and many small keys."""
    data = [("hot", at(5), i) for i in range(600)] + [("hot", None, -1)]
    data += [(None, at(i), 1000 + i) for i in range(300)]
    data += [(f"k{i % 40}", at(i), 2000 + i) for i in range(200)]
    return spark.createDataFrame(data, "k string, ts timestamp_ntz, n int")


def test_hot_and_null_keys_and_bursts_are_cut(crowded):
    blocks = Blocks(crowded, ["k"], [F.col("ts"), F.col("n")], partitions=20)
    found = blocks.rows.groupBy("k", blocks.block).agg(F.count("*").alias("n"), F.min("n").alias("a"), F.max("n").alias("b")).collect()
    assert sum(r["n"] for r in found) == crowded.count()
    assert max(r["n"] for r in found) < 250
    assert len([r for r in found if r.k == "hot"]) >= 5 and len([r for r in found if r.k is None]) >= 3
    burst = sorted((r[blocks.block], r.a, r.b) for r in found if r.k == "hot")
    assert all(x[2] < y[1] for x, y in zip(burst, burst[1:], strict=False))


@pytest.mark.parametrize("partitions", [1, 7, 50])
def test_carried_counts_do_not_depend_on_the_cuts(crowded, partitions):
    blocks = Blocks(crowded, ["k"], [F.col("ts"), F.col("n")], partitions)
    earlier = Window.partitionBy("k").orderBy(blocks.block).rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.rows.groupBy(*blocks.by).agg(F.count("*").alias("c"))
    carry = sizes.select(*blocks.by, F.sum("c").over(earlier).alias("before"))
    within = F.row_number().over(Window.partitionBy(*blocks.by).orderBy("ts", "n"))
    rows = blocks.with_carry(blocks.rows.withColumn("at", within), carry)
    found = {r["n"]: r["at"] + (r["before"] or 0) for r in rows.collect()}
    plain = F.row_number().over(Window.partitionBy("k").orderBy("ts", "n"))
    assert found == {r["n"]: r["at"] for r in crowded.withColumn("at", plain).collect()}
