"""Keys with a third of all rows or more are split in joins, and columns named like an operator's own stay."""

import contextlib

import pytest
from pyspark.sql import functions as F

from convoframe.operators import catalog, chats, logs, messages, settings, status
from convoframe.sources import chat_log

CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
    "spark.sql.shuffle.partitions": "12",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        with contextlib.suppress(Exception):
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def split(df):
    """Whether the plan that ran splits a skewed side of a join."""
    df.collect()
    return "skew=true" in df._jdf.queryExecution().executedPlan().toString()


def hot(spark, n=6000):
    """Rows of which one key has a third, over many tasks."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string")))
    return spark.range(n).repartition(8).select("id", key.alias("name"), F.sha2(F.col("id").cast("string"), 256).alias("more"))


def test_requests_for_one_key_are_split(spark, small_partitions):
    rows = hot(spark)
    assert split(catalog.exists_in(rows, rows.select("name")))


def test_items_of_one_name_are_split(spark, small_partitions):
    items = hot(spark).withColumn("owner", F.lit("o"))
    grants = items.select("name", F.lit("o").alias("principal"), F.lit("MANAGE").alias("permission"))
    assert split(catalog.manageable(items, grants))
    assert split(catalog.manageable(items, grants, any_principal=True))


def test_status_rows_of_one_app_are_split(spark, small_partitions):
    rows = hot(spark).select(
        F.col("name").alias("app_id"),
        "more",
        F.lit("u").alias("url"),
        F.expr("named_struct('state', more, 'message', more)").alias("app_status"),
        F.expr("named_struct('state', more, 'message', more)").alias("compute_status"),
        F.expr(
            "named_struct('deployment_id', more, 'status', named_struct('state', 's', 'message', 'm'),"
            " 'create_time', 'c', 'update_time', 'u', 'creator', 'me')"
        ).alias("active_deployment"),
    )
    deployments = rows.select("app_id", F.col("more").alias("deployment_id"), F.col("more").alias("create_time"), F.lit("OK").alias("state"))
    assert split(status.status_report(rows, deployments))


def test_prompts_of_one_chat_are_split(spark, small_partitions):
    rows = hot(spark).select(F.col("name").alias("chat_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.col("more").alias("content"))
    given = rows.select("chat_id", F.lit("be brief").alias("system_prompt")).distinct()
    assert split(messages.build_prompts(rows, given, max_turns=3))


def test_one_writers_table_is_not_shuffled_to_one_task(spark, small_partitions, tmp_path):
    rows = spark.range(100).selectExpr("cast(id as string) as chat_id", "id as n")
    chat_log.write_batch(rows, str(tmp_path / "t"), 0, "only")
    current = chat_log.read_current(spark, str(tmp_path / "t"), "chat_id string, n long")
    assert "hashpartitioning(run" not in current._jdf.queryExecution().executedPlan().toString()
    assert current.count() == 100


# Names that operators use inside.
OWN = ("_rank", "_used", "_present", "_newest", "_key_chat_id", "_lines", "_errors", "_direct", "_block", "_at", "_before", "_began", "_carry_chat_id", "_Rank")


def named(df, *names):
    return df.select("*", *[F.lit(f"own {n}").alias(n) for n in names])


def kept(df, *names):
    rows = df.collect()
    assert rows
    for n in names:
        assert n in df.columns
        assert all(r[n] == f"own {n}" for r in rows), n


def test_callers_columns_stay(spark, tmp_path):
    names = [n for n in OWN if n != "_Rank"]
    items = named(spark.createDataFrame([("shared-a", "o"), ("b", "o"), ("c", "p")], "name string, owner string"), *names)
    kept(catalog.exists_in(items, items), *names)
    tiers = catalog.prioritised_fill(items.withColumn("tier", F.lit("own tier")), ordered=True)
    kept(tiers, *names, "tier")
    assert sorted(r["_tier"] for r in tiers.collect()) == [0, 1, 1]
    kept(catalog.manageable(items, items.selectExpr("name", "owner as principal", "'MANAGE' as permission")), *names)
    log = named(spark.createDataFrame([("x\nError: no",), ("{\"a\": 1} tail",), (None,)], "raw string"), *names)
    kept(logs.clean_errors(log), *names)
    kept(logs.extract_json(log), *names)
    saves = named(spark.createDataFrame([("a", 0, 1), ("a", 1, 1), ("a", 0, 2)], "chat_id string, part int, v int"), *names)
    assert [(r.part, r.v) for r in chats.upsert_chats(saves, saves, "v").collect()] == [(0, 2)]
    kept(chats.upsert_chats(saves, saves, "v"), *names)
    kept(chats.upsert_chats(saves.drop("part"), saves.drop("part"), "v"), *names)
    turns = named(spark.createDataFrame([("a", 3, "x"), ("a", 7, "y")], "chat_id string, turn long, content string"), *names)
    found = messages.number_turns(turns)
    kept(found, *names)
    assert sorted(r.turn for r in found.collect()) == [0, 1]
    chat_log.write_batch(named(spark.createDataFrame([("a", 1)], "chat_id string, n int"), *names), str(tmp_path / "t"), 0)
    schema = ", ".join(["chat_id string", "n int", *[f"{n} string" for n in names]])
    kept(chat_log.read_current(spark, str(tmp_path / "t"), schema), *names)


def test_names_are_free_in_any_case_of_letters(spark):
    saves = spark.createDataFrame([("a", 1, "mine")], "chat_id string, v int, _RANK string")
    assert [r["_RANK"] for r in chats.upsert_chats(saves, saves, "v").collect()] == ["mine"]


def test_settings_with_a_block_column(spark, at):
    events = spark.createDataFrame(
        [(1, 1, at(0), "gpt-4", 0.5, None, None, "own _block")],
        "session_id long, event_id long, ts timestamp_ntz, model string, temperature double, system_prompt string,"
        " dark_mode boolean, _block string",
    )
    assert [r["model"] for r in settings.effective_settings(events).collect()] == ["gpt-4"]
