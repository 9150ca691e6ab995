"""Queries over command logs, app status and catalogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoframe.functions import logs as log_rules
from convoframe.functions import times
from convoframe.operators import catalog, logs, sketches, status, usage
from convoframe.plans.registry import Tables, query, time_text
from convoframe.session import ROCKSDB, STATE_STORE, materialise, scratch_path
from convoframe.streaming.time_to_state import stream_time_to_state

_DAY = 86400
_TIME = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


@query(
    "j1_exists_in",
    """
    select name, name in (select name from v_grants where permission = 'MANAGE') as found
    from v_items""",
    ("v_items", "v_grants"),
)
def j1(t: Tables):
    held = t.view("v_grants").where("permission = 'MANAGE'")
    return catalog.exists_in(t.view("v_items"), held).select("name", "found")


@query(
    "j2_manageable",
    """
    select name, owner from v_items i where exists (select 1 from v_grants g
      where g.name = i.name and g.principal = i.owner and g.permission = 'MANAGE')""",
    ("v_items", "v_grants"),
)
def j2(t: Tables):
    return catalog.manageable(t.view("v_items"), t.view("v_grants"))


@query(
    "j2_manageable_by_anyone",
    "select name, owner from v_items where name in (select name from v_grants where permission = 'MANAGE')",
    ("v_items", "v_grants"),
)
def j2_any(t: Tables):
    return catalog.manageable(t.view("v_items"), t.view("v_grants"), any_principal=True)


def _starts_sql(in_time: str) -> str:
    """Starts with the next ready time, and whether it comes in time."""
    return f"""
    select app_id, event_id, start_ts, ready_ts, waited, coalesce({in_time}, false) as ok from (
      select s.app_id, s.event_id, s.ts as start_ts, min(r.ts) as ready_ts,
        epoch_us(min(r.ts)) - epoch_us(s.ts) as waited
      from v_status s left join v_status r
        on r.app_id = s.app_id and r.ts > s.ts and r.app_state = 'RUNNING' and r.compute_state = 'ACTIVE'
      where s.app_state = 'STARTING' group by s.app_id, s.event_id, s.ts)"""


def _start():
    return F.col("app_state") == "STARTING"


def _up():
    return (F.col("app_state") == "RUNNING") & (F.col("compute_state") == "ACTIVE")


@query(
    "j3_time_to_state",
    f"""
    select app_id, event_id, case when ok then 'ready' else 'timeout' end as outcome,
      case when ok then {_TIME.format("ready_ts")} end as ready_at,
      case when ok then waited / 1000000.0 end as elapsed_s
    from ({_starts_sql(f"waited <= {_DAY} * 1000000::bigint")})""",
    ("v_status",),
)
def j3(t: Tables):
    """With a day's limit: the rows lie hours apart."""
    return status.time_to_state(t.view("v_status"), _start(), _up(), timeout=_DAY).select(
        "app_id",
        "event_id",
        "outcome",
        time_text(F.col("ready_ts")).alias("ready_at"),
        F.col("elapsed_s").cast("double").alias("elapsed_s"),
    )


@query(
    "j3_time_to_state_polled",
    f"""
    select app_id, event_id, case when ok then 'ready' else 'timeout' end as outcome,
      case when ok then cast((look + 900) // 60 as varchar) || 'm 0s elapsed' end as elapsed
    from (select *, cast(ceil(waited / 900000000.0) as bigint) * 900 as look
      from ({_starts_sql(f"ceil(waited / 900000000.0) * 900 < {_DAY}")}))""",
    ("v_status",),
)
def j3_polled(t: Tables):
    """The same, looking every quarter of an hour."""
    found = status.time_to_state(t.view("v_status"), _start(), _up(), timeout=_DAY, poll_every=900)
    return found.select("app_id", "event_id", "outcome", "elapsed")


@query(
    "t2_stream_time_to_state",
    f"""
    select app_id, event_id, case when ok then 'ready' else 'timeout' end as outcome,
      case when ok then {_TIME.format("ready_ts")} end as ready_at
    from ({_starts_sql(f"waited <= {_DAY} * 1000000::bigint")})""",
    ("v_status",),
)
def t2(t: Tables):
    """All starts, as a stream that takes up its checkpoint for each third of the time; one late row of an app of
    its own closes it."""
    rows = t.view("v_status")
    at = times.micros(F.col("ts"), dict(rows.dtypes)["ts"])
    late = (F.max("ts") + F.make_dt_interval(days=F.lit(4))).alias("ts")
    closing = rows.agg(late).select(
        F.lit(-1).cast("bigint").alias("app_id"),
        F.lit(-1).cast("bigint").alias("event_id"),
        "ts",
        F.lit("RUNNING").alias("app_state"),
        F.lit("ACTIVE").alias("compute_state"),
    )
    third, two = rows.agg(F.percentile_approx(at, [1 / 3, 2 / 3])).first()[0] or (0, 0)
    thirds = [rows.where(at < third), rows.where((at >= third) & (at < two)), rows.where(at >= two)]
    thirds[-1] = thirds[-1].unionByName(closing)
    source, out = scratch_path(t.spark, "status"), scratch_path(t.spark, "time-to-state")
    checkpoint = scratch_path(t.spark, "stream")
    before = t.spark.conf.get(STATE_STORE, None)
    t.spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        for part in thirds:
            part.write.mode("append").parquet(source)
            stream = t.spark.readStream.schema(rows.schema).parquet(source)
            decided = stream_time_to_state(stream, _start(), _up(), timeout=_DAY)
            writer = decided.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
            writer.start(out).awaitTermination()
    finally:
        if before is None:
            t.spark.conf.unset(STATE_STORE)
        else:
            t.spark.conf.set(STATE_STORE, before)
    return t.spark.read.schema(decided.schema).parquet(out).select(
        "app_id", "event_id", "outcome", time_text(F.col("ready_ts")).alias("ready_at")
    )


@query(
    "j3_time_to_delete",
    f"""
    select app_id, event_id, case when ok then 'ready' else 'timeout' end as outcome
    from (select app_id, event_id, coalesce(ceil((epoch_us(gone) - epoch_us(ts)) / 10000000.0) * 10 < 300, false) as ok
      from (select s.app_id, s.event_id, s.ts, min(r.ts) as gone from v_status s left join v_status r
          on r.app_id = s.app_id and r.ts > s.ts and r.app_state = 'CRASHED'
        where s.app_state = 'PENDING' group by s.app_id, s.event_id, s.ts))""",
    ("v_status",),
)
def j3_delete(t: Tables):
    """The wait for a deletion: 30 looks, 10 seconds apart. Pending apps stand for those being deleted,
    crashed ones for those gone."""
    pending, gone = F.col("app_state") == "PENDING", F.col("app_state") == "CRASHED"
    found = status.time_to_state(t.view("v_status"), pending, gone, timeout=300, poll_every=10)
    return found.select("app_id", "event_id", "outcome")


@query(
    "c4_already_up",
    "select event_id, compute_state = 'ACTIVE' or app_state = 'RUNNING' as up from v_status",
    ("v_status",),
)
def c4_up(t: Tables):
    up = log_rules.already_up(F.col("app_state"), F.col("compute_state"))
    return t.view("v_status").select("event_id", up.alias("up"))


@query(
    "a1_tier_counts",
    """
    select owner, count(*) filter (starts_with(lower(name), 'shared')) as n_shared, count(*) as n
    from v_items group by owner""",
    ("v_items",),
)
def a1(t: Tables):
    return catalog.tier_counts(t.view("v_items"))


@query(
    "a1_first_tier_names",
    "select owner, name from v_items where starts_with(lower(name), 'shared')",
    ("v_items",),
)
def a1_names(t: Tables):
    return catalog.first_tier(t.view("v_items")).select("owner", "name")


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_NOISY = " or ".join(f"contains(x, '{word}')" for word in log_rules.NOISE)
_FAULTY = " or ".join(f"contains(lower(x), '{word}')" for word in log_rules.ERROR_WORDS)
_CLEAN = f"""
    select *, case when raw is null or raw = '' then 'Unknown error occurred'
      when len(errors) > 0 then array_to_string(errors, chr(10))
      when len(readable) > 0 then readable[-1] else raw end as message
    from (select *, list_filter(lines, lambda x: not ({_NOISY}) and ({_FAULTY})) as errors,
        list_filter(lines, lambda x: x <> '' and not contains(x, 'CLI v0.')) as readable
      from (select *, list_transform(string_split({_STRIP.format("raw")}, chr(10)),
          lambda x: {_STRIP.format("x")}) as lines
        from v_log))"""
_CLASSED = f"""
    select *, case when contains(m, 'max limit') and contains(m, 'scope') then 'Workspace Limit Reached'
      when contains(m, 'permission') or contains(m, 'access') then 'Permission Error'
      when contains(m, 'not found') then 'Resource Not Found'
      when contains(m, 'invalid') or contains(m, 'bad request') then 'Invalid Request'
      else 'Error' end as error_type
    from (select *, lower(message) as m from ({_CLEAN}))"""


@query("c1_clean_errors", f"select event_id, message from ({_CLEAN})", ("v_log",))
def c1(t: Tables):
    return logs.clean_errors(t.view("v_log")).select("event_id", "message")


@query("c2_classify_errors", f"select event_id, error_type from ({_CLASSED})", ("v_log",))
def c2(t: Tables):
    cleaned = logs.clean_errors(t.view("v_log"))
    return logs.classify_errors(cleaned).select("event_id", "error_type")


@query(
    "a3_error_summary",
    f"""
    select error_type, count(*) as n, {_TIME.format("min(ts)")} as first_ts,
      {_TIME.format("max(ts)")} as last_ts, count(*) / (select count(*) from events)::double as share
    from ({_CLASSED}) group by error_type""",
    ("v_log",),
)
def a3(t: Tables):
    return logs.error_summary(t.view("v_log")).withColumns(
        {c: time_text(F.col(c)) for c in ("first_ts", "last_ts")}
    )


@query(
    "c3_extract_json",
    """
    select event_id, case when event_type in ('view', 'click', 'error') then props end as json
    from v_json""",
    ("v_json",),
)
def c3(t: Tables):
    return logs.extract_json(t.view("v_json")).select("event_id", "json")


_HEALTH = """case when app_state = 'RUNNING' and compute_state = 'ACTIVE' then 'Healthy'
      when app_state in ('PENDING', 'STARTING') or compute_state in ('PENDING', 'STARTING')
        then 'Starting' else 'Issue Detected' end"""


@query("c4_classify_health", f"select event_id, {_HEALTH} as health from v_status", ("v_status",))
def c4(t: Tables):
    return status.classify_health(t.view("v_status")).select("event_id", "health")


@query("a4_health_summary", f"select {_HEALTH} as health, count(*) as n from v_status group by 1", ("v_status",))
def a4(t: Tables):
    return status.health_summary(t.view("v_status"))


@query(
    "w7_recent_deployments",
    """
    select app_id, deployment_id, state, rank from (select *, row_number() over
      (partition by app_id order by create_time desc, deployment_id) as rank from v_deployments)
    where rank <= 3""",
    ("v_deployments",),
)
def w7(t: Tables):
    return status.recent_deployments(t.view("v_deployments")).drop("create_time")


@query(
    "c5_status_report",
    f"""
    select s.event_id, s.app_id, {_HEALTH} as health, app_state, compute_state,
      coalesce(case when event_type <> 'view' then 'no news' end, 'No message') as app_message,
      'example' as platform,
      case when event_type <> 'click' then left('dep' || cast(s.event_id as varchar) || 'abcdef', 8) || '...' end
        as deployment,
      'https://app' || cast(s.app_id as varchar) || '.example.com' as url, 'No message' as compute_message,
      case when event_type <> 'click' then 'Unknown' end as deployment_state,
      case when event_type <> 'click' then 'No message' end as deployment_message,
      case when event_type <> 'click' then 'Unknown' end as created,
      case when event_type <> 'click' then 'Unknown' end as updated,
      case when event_type <> 'click' then 'Unknown' end as creator, d.recent
    from v_status s join events e on e.event_id = s.event_id
    join (select app_id, string_agg(state || ' at ' || {_TIME.format("create_time")}, chr(10) order by rank)
        as recent
      from (select *, row_number() over (partition by app_id order by create_time desc, deployment_id)
        as rank from v_deployments) where rank <= 3 group by app_id) d on d.app_id = s.app_id""",
    ("v_status", "v_deployments"),
)
def c5(t: Tables):
    """Every status row as a nested document, with its app's last deployments."""
    rows = t.view("v_status")
    kind = t.read("events").select("event_id", "event_type")
    none = F.lit(None).cast("string")
    docs = rows.join(kind, "event_id").select(
        "app_id",
        "event_id",
        F.concat(F.lit("https://app"), F.col("app_id").cast("string"), F.lit(".example.com")).alias("url"),
        F.struct(
            F.col("app_state").alias("state"),
            F.when(F.col("event_type") != "view", "no news").alias("message"),
        ).alias("app_status"),
        F.struct(F.col("compute_state").alias("state"), none.alias("message")).alias("compute_status"),
        F.when(
            F.col("event_type") != "click",
            F.struct(
                F.concat(F.lit("dep"), F.col("event_id").cast("string"), F.lit("abcdef")).alias("deployment_id"),
                F.struct(none.alias("state"), none.alias("message")).alias("status"),
                none.alias("create_time"),
                none.alias("update_time"),
                none.alias("creator"),
            ),
        ).alias("active_deployment"),
    )
    report = status.status_report(docs, t.view("v_deployments"))
    lines = F.transform("recent", lambda d: F.concat(d["state"], F.lit(" at "), time_text(d["create_time"])))
    return report.select(
        "event_id",
        "app_id",
        "health",
        "app_state",
        "compute_state",
        "app_message",
        "platform",
        "deployment",
        "url",
        "compute_message",
        "deployment_state",
        "deployment_message",
        "created",
        "updated",
        "creator",
        F.array_join(lines, "\n").alias("recent"),
    )


@query(
    "c5_status_list",
    """
    select 'app' || cast(user_id as varchar) || '/' || cast(event_id as varchar) as name,
      case when event_type = 'view' then 'Unknown' else upper(event_type) end as app_state
    from events""",
)
def c5_list(t: Tables):
    kind = F.col("event_type")
    docs = t.read("events").select(
        F.concat(
            F.lit("app"), F.col("user_id").cast("string"), F.lit("/"), F.col("event_id").cast("string")
        ).alias("name"),
        F.when(
            kind != "view",
            F.struct(F.upper(kind).alias("state"), F.lit(None).cast("string").alias("message")),
        ).alias("app_status"),
    )
    return status.status_list(docs)


_FILL_SQL = """
    select name, owner, tier::bigint as tier from (
      select *, row_number() over (partition by owner, tier order by name) as r,
        count(*) filter (tier = 0) over (partition by owner) as used
      from (select i.*, case when starts_with(lower(i.name), 'shared') then 0 else 1 end as tier
        from v_items i where exists (select 1 from v_grants g
          where g.name = i.name and g.principal = i.owner and g.permission = 'MANAGE')))
    where tier = 0 or r <= 20 - used"""


@query("w8_prioritised_fill", _FILL_SQL, ("v_items", "v_grants"))
def w8(t: Tables):
    items = catalog.manageable(t.view("v_items"), t.view("v_grants"))
    return catalog.prioritised_fill(items)


@query(
    "c6_parse_listing",
    """
    select c_custkey as source, 1::bigint as place, c_name as name from customer
    union all select c_custkey, 2, 'segment-' || c_mktsegment from customer""",
)
def c6(t: Tables):
    return logs.parse_listing(t.view("v_listing"))


@query(
    "c7_derive_owner",
    """
    select user_id, email, slug, slug || '-chatbot' as scope_name, slug || '-ai-chatbot' as app_name,
      '/Workspace/Users/' || email || '/' || slug || '-ai-chatbot' as workspace_path
    from (select *, replace(split_part(email, '@', 1), '.', '-') as slug
      from (select user_id, coalesce(email, user_name) as email from v_users))""",
    ("v_users",),
)
def c7(t: Tables):
    address = F.struct(F.col("email").alias("value"), F.lit(True).alias("primary"))
    second = F.struct(F.lit("second@example.com").alias("value"), F.lit(False).alias("primary"))
    users = t.view("v_users").select(
        "user_id", F.array(second, address).alias("emails"), F.col("user_name").alias("userName")
    )
    return logs.derive_owner(users)


_HOST = "split_part(split_part(url, '//', 2), '/', 1)"


@query(
    "c8_first_valid",
    f"""
    select page_id, host, coalesce(nullif(split_part(host, '.', 2), ''), 'Unknown') as region, cloud
    from (select page_id, case when starts_with(url, 'https') then 'AWS' when length(html) > 1500 then 'AZURE' end
        as cloud, case when starts_with(url, 'https') or length(html) > 1500 then {_HOST}
      else 'config.example.com' end as host from pages)""",
)
def c8(t: Tables):
    """Pages stand for profiles: one is valid when its page is secure, one when it is long."""
    host = F.split_part(F.split_part("url", F.lit("//"), F.lit(2)), F.lit("/"), F.lit(1))

    def profile(valid, cloud):
        return F.struct(host.alias("host"), valid.alias("valid"), F.lit(cloud).alias("cloud"))

    rows = t.read("pages").select(
        "page_id",
        F.array(
            profile(F.col("url").startswith("https"), "aws"), profile(F.length("html") > 1500, "azure")
        ).alias("profiles"),
        F.lit("config.example.com").alias("config_host"),
    )
    return logs.first_valid(rows).select("page_id", "host", "region", "cloud")


@query(
    "c9_extract_secret_refs",
    """
    select event_id, 'scope' || cast(user_id as varchar) as scope, 'key_a' as name
    from events where event_type = 'view'
    union all select event_id, 'shared', 'key_' || cast(event_id as varchar)
    from events where event_type = 'view'""",
)
def c9(t: Tables):
    return logs.extract_secret_refs(t.view("v_config"))


@query(
    "x6_log_metrics",
    f"""
    select {_TIME.format("date_trunc('hour', ts)")} as window_start, error_type, count(*) as n,
      cast(quantile_disc(length(raw), 0.5) as bigint) as median_chars
    from ({_CLASSED}) group by 1, 2""",
    ("v_log",),
)
def x6(t: Tables):
    return usage.log_metrics(t.view("v_log")).withColumn("window_start", time_text(F.col("window_start")))


_SIZED = f"""
  select {_TIME.format("date_trunc('day', ts)")} as day, error_type, length(raw) as x,
    row_number() over (partition by date_trunc('day', ts), error_type order by length(raw)) as r,
    count(*) over (partition by date_trunc('day', ts), error_type) as n
  from ({_CLASSED})"""


@query(
    "x6_day_sketches",
    f"""
    select day, error_type, n,
      max(case when r = ceil(0.5 * n) then (x >> s) << s end) as median_chars,
      max(case when r = ceil(0.95 * n) then (x >> s) << s end) as p95_chars
    from (select *, greatest(length(bin(x)) - 8, 0) as s from ({_SIZED})) group by 1, 2, 3""",
    ("v_log",),
)
def x6_days(t: Tables):
    """Sketches of each hour's log lengths by class, written, and merged to days."""
    log = t.view("v_log")
    classed = logs.classify_errors(logs.clean_errors(log, "raw"))
    hours = sketches.quantile_sketch(
        classed, {"hour": F.date_trunc("hour", "ts"), "error_type": F.col("error_type")}, F.length("raw")
    )
    hours = materialise(hours, "hours")
    days = sketches.merge_sketches(hours, {"day": F.date_trunc("day", "hour"), "error_type": F.col("error_type")})
    found = sketches.sketch_quantiles(days, ("day", "error_type"), {"median_chars": 0.5, "p95_chars": 0.95})
    return found.withColumn("day", time_text(F.col("day")))
