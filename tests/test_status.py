import os
import random
import time

import pytest
from pyspark.sql import functions as F

from convoframe import schemas
from convoframe.operators import catalog, status
from convoframe.streaming.time_to_state import stream_time_to_state

STATUS = "app_id string, event_id bigint, ts timestamp_ntz, state string"


def start():
    return F.col("state") == "S"


def ready():
    return F.col("state") == "R"


def outcome(df):
    return {r.event_id: (r.outcome, r.elapsed_s if r.elapsed_s is None else float(r.elapsed_s), r.elapsed)
            for r in df.collect()}


def test_time_to_state(spark, at):
    """ready exactly at the limit, before the start, never, at the very instant."""
    data = [
        ("a", 1, at(0), "S"), ("a", 2, at(300), "R"),
        ("b", 3, at(10), "R"), ("b", 4, at(20), "S"),
        ("c", 5, at(0), "S"), ("c", 6, at(0), "R"), ("c", 7, at(300.5), "R"),
        ("d", 8, at(0), "S"), ("d", 9, at(5), "S"), ("d", 10, at(65.25), "R"),
        ("e", 11, None, "S"),
    ]
    df = spark.createDataFrame(data, STATUS)
    assert outcome(status.time_to_state(df, start(), ready())) == {
        1: ("ready", 300.0, "5m 0s elapsed"), 4: ("timeout", None, None), 5: ("timeout", None, None),
        8: ("ready", 65.25, "1m 5s elapsed"), 9: ("ready", 60.25, "1m 0s elapsed"),
    }
    polled = outcome(status.time_to_state(df, start(), ready(), poll_every=15))
    assert polled[1] == ("timeout", None, None)
    assert polled[8] == ("ready", 65.25, "1m 30s elapsed")


@pytest.mark.parametrize("limit", [40, 5, 1])
def test_hot_apps_do_not_change_results(spark, at, limit):
    rng = random.Random(limit)
    data = [("hot" if rng.random() < 0.6 else f"a{rng.randrange(5)}", e, at(rng.randrange(2000)),
             rng.choice("SSR-")) for e in range(400)]
    found = status.time_to_state(spark.createDataFrame(data, STATUS), start(), ready(), 20, partitions=limit)
    expected = {}
    for app, e, ts, state in data:
        if state == "S":
            later = [t for a, _, t, s in data if a == app and s == "R" and t > ts]
            up = min(later, default=None)
            ok = up is not None and (up - ts).total_seconds() <= 20
            expected[e] = ("ready", up) if ok else ("timeout", None)
    assert {r.event_id: (r.outcome, r.ready_ts) for r in found.collect()} == expected


def test_a_row_may_start_and_be_ready(spark, at):
    df = spark.createDataFrame([("a", 1, at(0), "x"), ("a", 2, at(0), "x"), ("a", 3, at(9), "x")], STATUS)
    found = status.time_to_state(df, F.lit(True), F.lit(True), 60)
    assert {r.event_id: r.ready_ts for r in found.collect()} == {1: at(9), 2: at(9), 3: None}


@pytest.mark.parametrize("salts", [1, 4])
def test_stream_equals_batch(spark, at, tmp_path, salts):
    """Five files in time order, rows shuffled within each; a last row moves the watermark on."""
    rng = random.Random(3)
    data = [("hot" if rng.random() < 0.5 else f"a{rng.randrange(4)}", e, at(e * 7 + rng.random()),
             rng.choice("SSR-")) for e in range(300)]
    source = str(tmp_path / "in")
    for i in range(5):
        part = data[i * 60:(i + 1) * 60]
        rng.shuffle(part)
        spark.createDataFrame(part, STATUS).coalesce(1).write.mode("append").parquet(source)
    spark.createDataFrame([("z", 999, at(9000), "-"), ("z", 998, at(9000), "R")], STATUS).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(source)
    decided = stream_time_to_state(stream, start(), ready(), timeout=60, salts=salts)
    out = str(tmp_path / "out")
    query = decided.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    columns = ["app_id", "event_id", "start_ts", "outcome", "ready_ts"]
    found = spark.read.schema(decided.schema).parquet(out).select(columns).collect()
    batch = status.time_to_state(spark.createDataFrame(data, STATUS), start(), ready(), 60).select(columns)
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, batch.collect()), key=repr)


def test_late_rows_are_dropped(spark, at, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for row in [("a", 1, at(0), "S"), ("b", 2, at(5000), "R"), ("b", 4, at(5001), "R"),
                ("a", 3, at(10), "R"), ("b", 5, at(9000), "R")]:
        spark.createDataFrame([row], STATUS).coalesce(1).write.mode("append").parquet(source)
    # Files are read in order of their times.
    for i, name in enumerate(sorted((n for n in os.listdir(source) if n.endswith(".parquet")),
                                    key=lambda n: os.path.getmtime(f"{source}/{n}"))):
        os.utime(f"{source}/{name}", (time.time() + i, time.time() + i))
    stream = spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(source)
    decided = stream_time_to_state(stream, start(), ready(), timeout=60)
    query = decided.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    assert [(r.event_id, r.outcome) for r in spark.read.schema(decided.schema).parquet(out).collect()] == [
        (1, "timeout")]


def test_a_start_comes_out_when_its_time_is_over(spark, at, tmp_path):
    """One file a batch; the watermark is a minute behind the latest row before the batch."""
    source, seen = str(tmp_path / "in"), []
    # The timeout of 1 ends at 60, 2 is ready at 8, 3 waits for more.
    for row in [("a", 1, at(0), "S"), ("a", 2, at(2), "S"), ("a", 9, at(62), "R"), ("b", 3, at(70), "S"),
                ("c", 8, at(121), "R"), ("c", 8, at(131), "R"), ("c", 8, at(190), "R"), ("c", 8, at(191), "R")]:
        spark.createDataFrame([row], STATUS).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.01)
    stream = spark.readStream.schema(STATUS).option("maxFilesPerTrigger", 1).parquet(source)
    decided = stream_time_to_state(stream, start(), ready(), timeout=60, salts=2)

    def note(batch, number):
        seen.extend((number, r.event_id, r.outcome) for r in batch.collect())

    query = decided.writeStream.foreachBatch(note).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    # After 121 the watermark is 61, after 131 it is 71, after 190 130: each decides in the batch that follows.
    assert sorted(seen) == [(5, 1, "timeout"), (6, 2, "ready"), (7, 3, "timeout")]


def test_open_starts_are_the_state(spark, at, tmp_path):
    """Ready times and decided starts leave the state; many starts of one instant and equal ties stay apart."""
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", 1, at(5), "S")] * 3 + [("a", 2, at(5), "S")] + [("a", 10 + i, at(6 + i), "R") for i in range(200)]
    spark.createDataFrame(rows, STATUS).write.parquet(source)
    spark.createDataFrame([("a", 900, at(5000), "S"), ("z", 901, at(5000), "R")], STATUS).write.mode("append").parquet(source)
    stream = spark.readStream.schema(STATUS).parquet(source)
    decided = stream_time_to_state(stream, start(), ready(), timeout=60, salts=1)
    query = decided.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    query.awaitTermination()
    found = spark.read.schema(decided.schema).parquet(out).collect()
    assert sorted((r.event_id, r.outcome, r.ready_ts) for r in found) == [(1, "ready", at(6))] * 3 + [(2, "ready", at(6))]
    state = query.lastProgress["stateOperators"][0]["customMetrics"]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6, state


def test_many_apps_share_a_state(spark, at, tmp_path):
    """The state has no more rows than twice the groups, for any number of apps; null ids are an app and a tie."""
    rng = random.Random(5)
    apps = [None, *(f"a{i}" for i in range(400))]
    data = [(rng.choice(apps), i or None, at(rng.randrange(500)), rng.choice("SSR")) for i in range(1500)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame(data, STATUS).write.parquet(source)
    stream = spark.readStream.schema(STATUS).parquet(source)
    rows = []
    for groups in (3, 512):
        decided = stream_time_to_state(stream, start(), ready(), timeout=60, groups=groups)
        run = decided.writeStream.option("checkpointLocation", str(tmp_path / f"cp{groups}")).trigger(availableNow=True)
        query = run.start(f"{out}{groups}")
        query.awaitTermination()
        rows.append(max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress))
        found = spark.read.schema(decided.schema).parquet(f"{out}{groups}")
        expected = status.time_to_state(spark.createDataFrame(data, STATUS), start(), ready(), 60).select(found.columns)
        # The watermark stands at the latest row less a minute.
        expected = expected.where(F.coalesce("ready_ts", F.col("start_ts") + F.expr("interval 60 seconds")) <= F.lit(max(r[2] for r in data)) - F.expr("interval 60 seconds"))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    assert rows[0] <= 6


def test_health(spark):
    states = [("RUNNING", "ACTIVE"), ("RUNNING", "STARTING"), ("PENDING", "STOPPED"), ("RUNNING", "STOPPED"),
              (None, None), (None, "PENDING")]
    df = spark.createDataFrame(states, "app_state string, compute_state string")
    assert [r.health for r in status.classify_health(df).collect()] == [
        "Healthy", "Starting", "Starting", "Issue Detected", "Issue Detected", "Starting"]
    from convoframe.functions.logs import already_up
    up = df.select(already_up(F.col("app_state"), F.col("compute_state")).alias("up"))
    assert [r.up for r in up.collect()] == [True, True, False, True, False, False]


def test_status_report(spark):
    docs = spark.read.schema(schemas.APP_STATUS).json(spark.sparkContext.parallelize([
        '{"name": "one", "url": "https://one.cloud.example.com", "app_status": {"state": "RUNNING", "message": "ok"},'
        ' "compute_status": {"state": "ACTIVE"}, "active_deployment": {"deployment_id": "0123456789ab",'
        ' "status": {"state": "SUCCEEDED"}, "creator": "me"}}',
        '{"name": "two"}',
        '{"name": "three", "active_deployment": {"creator": "you"}}',
    ]))
    deployments = spark.createDataFrame(
        [("one", f"d{i}", f"2024-01-0{i}", "OK" if i != 4 else None) for i in range(1, 6)],
        "name string, deployment_id string, create_time string, state string")
    found = {r.name: r for r in status.status_report(docs, deployments, by="name").collect()}
    one, two, three = found["one"], found["two"], found["three"]
    assert (one.health, one.deployment, one.deployment_state, one.platform) == ("Healthy", "01234567...", "SUCCEEDED", "cloud")
    assert [(d.state, d.create_time) for d in one.recent] == [("OK", "2024-01-05"), ("Unknown", "2024-01-04"), ("OK", "2024-01-03")]
    assert (one.compute_message, one.created) == ("No message", "Unknown")
    assert (two.health, two.url, two.app_state, two.deployment, two.recent, two.platform) == (
        "Issue Detected", "Not available", "Unknown", None, None, "Unknown")
    assert (three.deployment, three.creator) == ("Unknown...", "you")
    assert [tuple(r) for r in status.status_list(docs).collect()] == [("one", "RUNNING"), ("two", "Unknown"), ("three", "Unknown")]


def test_recent_deployments_are_limited_before_the_shuffle(spark):
    df = spark.range(9).selectExpr("id % 2 as app_id", "cast(id as string) as deployment_id", "id as create_time")
    recent = status.recent_deployments(df, 2)
    assert sorted((r.deployment_id, r["rank"]) for r in recent.collect()) == [("5", 2), ("6", 2), ("7", 1), ("8", 1)]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def items(spark, *names, owner="o"):
    return spark.createDataFrame([(n, owner) for n in names], "name string, owner string")


def test_fill(spark):
    """more first-tier items than the cap, fewer items than the cap, names in two cases."""
    def filled(df, cap):
        return [r.name for r in catalog.prioritised_fill(df, cap, ordered=True).collect()]

    assert filled(items(spark, "b", "shared-2", "Shared-1", "SHARED", "a"), 2) == ["SHARED", "Shared-1", "shared-2"]
    assert filled(items(spark, "b", "shared-2", "a", "C"), 3) == ["shared-2", "a", "C"]
    assert filled(items(spark, "b", "a"), 20) == ["a", "b"]
    assert filled(items(spark, "b", "a", "c"), 0) == []
    two = items(spark, "b", "a").unionByName(items(spark, "x", "shared", owner="p"))
    assert filled(two, 1) == ["a", "shared"]


def test_grants(spark, rows):
    some = items(spark, "x", "y", "z")
    grants = spark.createDataFrame(
        [("x", "o", "MANAGE"), ("x", "o", "MANAGE"), ("y", "other", "MANAGE"), ("z", "o", "READ")],
        "name string, principal string, permission string")
    assert rows(catalog.manageable(some, grants)) == [("x", "o")]
    assert rows(catalog.manageable(some, grants, any_principal=True)) == [("x", "o"), ("y", "o")]
    assert rows(catalog.exists_in(some.select("name"), grants.where("permission = 'MANAGE'"))) == [
        ("x", True), ("y", True), ("z", False)]


def test_tiers(spark, rows):
    assert rows(catalog.tier_counts(items(spark, "Shared-a", "shared", "x-shared"))) == [("o", 2, 3)]
