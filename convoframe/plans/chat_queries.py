"""Queries over chats and their messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from convoframe import schemas
from convoframe.functions import ids, text
from convoframe.operators import chats, messages
from convoframe.plans.registry import Tables, query, time_text
from convoframe.session import scratch_path
from convoframe.sources import chat_log, intake
from convoframe.sources import chats as files
from convoframe.sources.chat_table import ChatTable


def _joined(column: str):
    return F.array_join(F.transform(column, lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")


def _documents(t: Tables):
    """Chat documents of the conversations; a chat without a system row has no name yet."""
    folded = chats.fold_messages(t.msgs).select(F.col("chat_id").cast("string").alias("chat_id"), "messages")
    named = F.col("messages")[0]["role"] == "system"
    return folded.select(
        "chat_id", F.when(named, F.concat(F.lit("chat "), "chat_id")).alias("chat_name"), "messages"
    )


# The documents above, in SQL.
_DOCS_SQL = """
  select cast(conv_id as varchar) as chat_id,
    case when min_by(role, turn) = 'system' then 'chat ' || cast(conv_id as varchar) end as chat_name,
    min_by(role, turn) as first_role, max_by(role, turn) as last_role, count(*) as n,
    string_agg(role || ': ' || text, chr(10) order by turn) as transcript
  from conversations group by conv_id"""


@query(
    "s1_read_chats",
    f"select chat_id, chat_name, n as n_messages, transcript from ({_DOCS_SQL})",
)
def s1(t: Tables):
    """One document per file, over several lines, as single saves leave them."""
    path = scratch_path(t.spark, "chats-json")
    whole = F.to_json(F.struct("chat_id", "chat_name", "messages"), {"pretty": "true"})
    docs = _documents(t).select("chat_id", whole.alias("value"))
    docs.repartition("chat_id").write.partitionBy("chat_id").text(path)
    read = files.read_chats(t.spark, f"{path}/chat_id=*", pattern="*.txt")
    good, _ = files.split_bad_chats(read)
    return good.select(
        "chat_id",
        "chat_name",
        F.size("messages").cast("bigint").alias("n_messages"),
        _joined("messages").alias("transcript"),
    )


@query(
    "s1_take_in",
    f"select chat_id, chat_name, n as n_messages, transcript from ({_DOCS_SQL})",
)
def s1_take_in(t: Tables):
    """Files of drafts and of finished chats, one for each, are taken in, then those that the finished drafts leave."""
    folder, table, ledger = (scratch_path(t.spark, name) for name in ("saved", "taken", "files"))
    docs = _documents(t)
    whole = F.to_json(F.struct("chat_id", "chat_name", "messages"), {"pretty": "true"})
    late = F.col("chat_id").cast("bigint") % 3 == 1
    draft = docs.withColumn("chat_name", F.when(late, "draft").otherwise(F.col("chat_name")))
    for part in (draft, docs.where(late)):
        part = part.select("chat_id", whole.alias("value")).repartition("chat_id").select("value")
        part.write.mode("append").option("maxRecordsPerFile", 1).text(folder)
        intake.take_in(t.spark, folder, table, ledger, "*.txt")
    return intake.read_taken(t.spark, table).select(
        "chat_id",
        "chat_name",
        F.size("messages").cast("bigint").alias("n_messages"),
        _joined("messages").alias("transcript"),
    )


@query(
    "s2_split_bad_chats",
    f"""
    select chat_id, case when first_role = 'system' then 'malformed'
      when last_role = 'user' then 'no_messages' else 'good' end as verdict
    from ({_DOCS_SQL})""",
)
def s2(t: Tables):
    """Documents that open with a system row are cut off; of the others, those that end on a user
    row lose their messages."""
    docs = _documents(t)
    cut = F.col("messages")[0]["role"] == "system"
    bare = F.element_at("messages", -1)["role"] == "user"
    whole = F.to_json(F.struct("chat_id", "chat_name", "messages"))
    line = F.when(cut, F.substring(whole, F.lit(1), F.length(whole) - 3)).when(
        bare, F.to_json(F.struct("chat_id", "chat_name"))
    ).otherwise(whole)
    path = scratch_path(t.spark, "chats-mixed")
    docs.select(line.alias("value")).write.text(path)
    read = files.read_chats(t.spark, path, lines=True, pattern="*.txt")
    good, bad = files.split_bad_chats(read)
    lost = F.regexp_extract(schemas.CORRUPT, r'"chat_id":"(\d+)"', 1)
    return good.select("chat_id", F.lit("good").alias("verdict")).unionByName(
        bad.select(F.coalesce("chat_id", lost).alias("chat_id"), F.col("reason").alias("verdict"))
    )


@query(
    "s3_write_chats",
    """
    select strftime(ts, '%Y%m%d_%H%M%S') as chat_id, strftime(ts, '%Y%m%d') as chat_day,
      event_type as chat_name, props as content
    from events""",
)
def s3(t: Tables):
    docs = t.read("events").select(
        ids.chat_id_from_ts(F.col("ts")).alias("chat_id"),
        F.col("event_type").alias("chat_name"),
        F.array(F.struct(F.lit("user").alias("role"), F.col("props").alias("content"))).alias("messages"),
    )
    path = scratch_path(t.spark, "chats-parquet")
    files.write_chats(docs, path, partition_by="chat_day")
    return t.spark.read.parquet(path).select(
        "chat_id",
        F.col("chat_day").cast("string").alias("chat_day"),
        "chat_name",
        F.col("messages")[0]["content"].alias("content"),
    )


_LATEST_SQL = """
  select chat_id, event_type, value, event_id from (
    select cast(user_id as varchar) as chat_id, event_type, value, event_id,
      row_number() over (partition by user_id order by ts desc, event_id desc) as r from events)
  where r = 1"""


@query("s4_upsert_chats", _LATEST_SQL)
def s4(t: Tables):
    saves = t.read("events").select(
        F.col("user_id").cast("string").alias("chat_id"), "event_type", "value", "event_id", "ts"
    )
    base, updates = saves.where("event_type = 'signup'"), saves.where("event_type <> 'signup'")
    return chats.upsert_chats(base, updates, ["ts", "event_id"]).drop("ts")


@query(
    "s5_delete_chats",
    """
    select conv_id as chat_id, turn from conversations
    where conv_id not in (select conv_id from conversations where role = 'system')""",
)
def s5(t: Tables):
    gone = t.msgs.where("role = 'system'").select("chat_id")
    return chats.delete_chats(t.msgs, gone).select("chat_id", "turn")


@query(
    "s5_missing_ids",
    """
    select distinct user_id as chat_id from events
    where user_id not in (select conv_id from conversations)""",
)
def s5_missing(t: Tables):
    return chats.missing_ids(t.msgs, t.read("events").select(F.col("user_id").alias("chat_id")))


@query("p1_list_chats", f"select chat_id, chat_name from ({_DOCS_SQL})")
def p1(t: Tables):
    return chats.list_chats(_documents(t))


@query(
    "p2_load_chat",
    """
    select cast(conv_id as varchar) as chat_id, 'chat ' || cast(conv_id as varchar) as chat_name,
      turn, role, text as content
    from conversations
    where conv_id in (select conv_id from conversations where role = 'system')""",
)
def p2(t: Tables):
    chosen = t.msgs.where("role = 'system'").select(F.col("chat_id").cast("string").alias("chat_id"))
    return chats.load_chat(_documents(t), chosen)


@query(
    "p3_fold_messages",
    f"select cast(chat_id as bigint) as chat_id, n as n_messages, transcript from ({_DOCS_SQL})",
)
def p3(t: Tables):
    return chats.fold_messages(t.msgs).select(
        "chat_id",
        F.size("messages").cast("bigint").alias("n_messages"),
        _joined("messages").alias("transcript"),
    )


@query(
    "p4_render_transcript",
    f"select cast(chat_id as bigint) as chat_id, 0::bigint as part, transcript from ({_DOCS_SQL})",
)
def p4(t: Tables):
    return chats.render_transcript(t.msgs)


@query(
    "p8_validate_messages",
    """
    select event_id, case when event_type = 'error' then 'missing_content'
      when event_type = 'view' then 'empty_content'
      when event_type = 'purchase' then 'unknown_role' end as reason
    from events""",
)
def p8(t: Tables):
    kind = F.col("event_type")
    rows = t.read("events").select(
        "event_id",
        F.when(kind == "purchase", "tool").when(kind == "click", "system").otherwise("user").alias("role"),
        F.when(kind == "view", "").when(kind == "signup", "   ").when(kind != "error", F.col("props")).alias("content"),
    )
    return messages.validate_messages(rows).select("event_id", "reason")


@query("p9_migrate_legacy", f"select chat_id, 'old ' || chat_id as chat_name, n as n_messages from ({_DOCS_SQL})")
def p9(t: Tables):
    """Chats with a name are new documents, the others old ones."""
    docs = _documents(t)
    old = F.col("chat_name").isNull()
    name = F.concat(F.lit("old "), "chat_id")
    mixed = docs.select(
        F.when(old, F.concat(F.lit("chat_"), "chat_id")).alias("id"),
        F.when(old, name).alias("name"),
        F.when(~old, F.col("chat_id")).alias("chat_id"),
        F.when(~old, name).alias("chat_name"),
        "messages",
    )
    return chats.migrate_legacy(mixed).select(
        "chat_id", "chat_name", F.size("messages").cast("bigint").alias("n_messages")
    )


@query(
    "w1_pair_turns",
    """
    select conv_id as chat_id, turn, text as question,
      case when next_role = 'assistant' then next_turn end as reply_turn,
      case when next_role = 'assistant' then next_text end as reply
    from (select *, lead(role) over w as next_role, lead(turn) over w as next_turn,
        lead(text) over w as next_text
      from conversations window w as (partition by conv_id order by turn))
    where role = 'user'""",
)
def w1(t: Tables):
    return messages.pair_turns(t.msgs)


def _history_sql(frame: str) -> str:
    return f"""
    select conv_id as chat_id, turn, text as content, coalesce(array_to_string(past, chr(10)), '') as history
    from (select *, list(role || ': ' || text) over
        (partition by conv_id order by turn rows between {frame} and 1 preceding) as past
      from conversations)
    where role = 'user'"""


@query("w2_build_context", _history_sql("unbounded preceding"))
def w2(t: Tables):
    context = messages.build_context(t.msgs)
    return context.select("chat_id", "turn", "content", _joined("history").alias("history"))


@query("w2_build_context_bounded", _history_sql("3 preceding"))
def w2_bounded(t: Tables):
    context = messages.build_context(t.msgs, max_turns=3)
    return context.select("chat_id", "turn", "content", _joined("history").alias("history"))


PROMPTS_SQL = f"""
    select p.conv_id as chat_id, p.turn,
      'system: ' || coalesce(s.text, '{schemas.DEFAULT_SYSTEM_PROMPT}') || chr(10)
        || coalesce(array_to_string(past, chr(10)) || chr(10), '') || 'human: ' || p.text as prompt
    from (select *, list(role || ': ' || text) over
        (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as past
      from conversations where role <> 'system') p
    left join conversations s on s.conv_id = p.conv_id and s.turn = 0 and s.role = 'system'
    where p.role = 'user'"""


@query("w3_build_prompts", PROMPTS_SQL)
def w3(t: Tables):
    prompts = messages.build_prompts(t.msgs)
    return prompts.select("chat_id", "turn", _joined("prompt").alias("prompt"))


@query(
    "w6_first_messages",
    """
    select conv_id as chat_id, min(turn) as turn, min_by(text, turn) as content
    from conversations where role = 'user' group by conv_id""",
)
def w6(t: Tables):
    return chats.first_messages(t.msgs)


def _title_sql(text: str) -> str:
    kept = (
        f"list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+'), "
        "lambda w: not regexp_matches(w, '^\\p{N}+$'))"
    )
    caps = f"list_transform(({kept})[1:5], lambda w: upper(w[1]) || lower(w[2:]))"
    return f"nullif(array_to_string({caps}, ' '), '')"


_TITLES_SQL = f"""
    select conv_id as chat_id, {_title_sql("min_by(text, turn)")} as chat_name
    from conversations where role = 'user' group by conv_id"""


@query("c11_title_chats", _TITLES_SQL)
def c11(t: Tables):
    return chats.title_chats(t.msgs)


@query(
    "c11_title_prompts",
    f"""
    select conv_id as chat_id, min(turn) as turn, '{chats.TITLE_INSTRUCTION}' as instruction,
      'Give a title for the chat that starts with this message: ' || min_by(text, turn) as request
    from conversations
    where role = 'user' and conv_id not in (select conv_id from conversations where role = 'system')
    group by conv_id""",
)
def c11_prompts(t: Tables):
    """Chats that open with a system row have a name already."""
    prompts = chats.title_prompts(t.msgs, _documents(t).withColumn("chat_id", F.col("chat_id").cast("bigint")))
    parts = [F.col("prompt")[i]["content"] for i in (0, 1)]
    return prompts.select("chat_id", "turn", parts[0].alias("instruction"), parts[1].alias("request"))


@query(
    "c12_check_titles",
    """
    select event_id, array_to_string(list_filter([
        case when not (n between 2 and 5) then 'word_count' end,
        case when regexp_matches(name, '[^\\p{L}\\p{N}\\s]') then 'special_characters' end,
        case when len(list_filter(parts, lambda w: regexp_matches(w, '^\\p{Ll}'))) > 0 then 'capitals' end,
        case when len(list_filter(parts, lambda w: regexp_matches(w, '^\\p{N}+$'))) > 0 then 'digits' end
      ], lambda r: r is not null), ',') as reasons
    from (select *, len(parts) as n from (select *, string_split(name, ' ') as parts from (
      select event_id, case event_type when 'view' then 'View Of ' || user_id
        when 'click' then 'click It!' when 'error' then 'Error'
        else 'Good Title' end as name from events)))""",
)
def c12(t: Tables):
    kind = F.col("event_type")
    names = t.read("events").select(
        "event_id",
        F.when(kind == "view", F.concat(F.lit("View Of "), F.col("user_id").cast("string")))
        .when(kind == "click", "click It!")
        .when(kind == "error", "Error")
        .otherwise("Good Title")
        .alias("chat_name"),
    )
    return chats.check_titles(names).select("event_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    "titled_listing",
    f"""
    select t.chat_id, t.chat_name, c.n_messages from ({_TITLES_SQL}) t
    join (select conv_id, count(*) as n_messages from conversations group by conv_id) c
      on c.conv_id = t.chat_id""",
)
def titled_listing(t: Tables):
    """First messages, titles and message counts in one pass over the messages."""
    user_turn = F.when(F.col("role") == "user", F.col("turn"))
    per_chat = t.msgs.groupBy("chat_id").agg(
        F.min_by("content", user_turn).alias("first_message"),
        F.min(user_turn).alias("first_turn"),
        F.count(F.lit(1)).alias("n_messages"),
    )
    return per_chat.where("first_turn is not null").select(
        "chat_id", text.title(F.col("first_message")).alias("chat_name"), "n_messages"
    )


_IDS_SQL = "select strftime(ts, '%Y%m%d_%H%M%S') as chat_id, event_id from events"


@query("a2_id_collisions", f"select chat_id, count(*) as claims from ({_IDS_SQL}) group by 1 having count(*) > 1")
def a2(t: Tables):
    claimed = t.read("events").select(ids.chat_id_from_ts(F.col("ts")).alias("chat_id"))
    return chats.id_collisions(claimed)


@query(
    "c10_chat_ids",
    """
    select event_id, strftime(ts, '%Y%m%d_%H%M%S') as chat_id,
      strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S.%f') as started
    from events""",
)
def c10(t: Tables):
    with_id = t.read("events").select("event_id", ids.chat_id_from_ts(F.col("ts")).alias("chat_id"))
    return with_id.withColumn("started", time_text(ids.chat_id_to_ts(F.col("chat_id"))))


@query(
    "u2_append_responses",
    """
    select chat_id, row_number() over (partition by chat_id order by turn, after) - 1 as turn, role, content
    from (select conv_id as chat_id, turn, role, text as content, 0 as after from conversations
      union all
      select conv_id, turn, 'assistant', 'echo ' || text, 1 from conversations where role = 'user')""",
)
def u2(t: Tables):
    """Every user turn is answered anew, by rows as the model's batch job gives them."""
    replies = t.msgs.where("role = 'user'").select(
        "chat_id",
        "turn",
        F.concat(F.lit("echo "), "content").alias("response"),
        F.lit(None).cast("string").alias("error"),
    )
    appended, _ = messages.append_responses(t.msgs, replies)
    return appended


@query(
    "number_turns",
    """
    select conv_id as chat_id, row_number() over (partition by conv_id order by turn) - 1 as turn, role, text as content
    from conversations where role <> 'system'""",
)
def number_turns(t: Tables):
    return messages.number_turns(t.msgs.where("role <> 'system'"))


@query("x7_table_history", _LATEST_SQL)
def x7(t: Tables):
    """Two saved batches, compacted, and the newest row per chat read back."""
    saves = t.read("events").select(
        F.col("user_id").cast("string").alias("chat_id"), "event_type", "value", "event_id", "ts"
    )
    path = scratch_path(t.spark, "chat-log")
    # A batch is a moment: later batches hold later saves.
    middle = saves.agg(F.percentile_approx("event_id", 0.5).alias("m")).select("m").scalar()
    chat_log.write_batch(saves.where(F.col("event_id") <= middle), path, 0)
    chat_log.write_batch(saves.where(F.col("event_id") > middle), path, 1)
    compacted = scratch_path(t.spark, "chat-log")
    chat_log.compact(t.spark, path, compacted, saves.schema, version=("ts", "event_id"))
    return chat_log.read_current(t.spark, compacted, saves.schema, version=("ts", "event_id")).drop("ts")


def _saves(t: Tables):
    """Events as saves of one chat for each user; the earlier half of the ids, and the later one."""
    saves = t.read("events").select(F.col("user_id").cast("string").alias("chat_id"), "event_type", "value", "event_id")
    half = F.col("event_id") * 2 <= saves.agg(F.max("event_id").alias("m")).select("m").scalar()
    return saves, saves.where(half), saves.where(~half)


@query(
    "s4_published_saves",
    """
    with e as (
      select cast(user_id as varchar) as chat_id, event_type, value, event_id,
        event_id * 2 <= (select max(event_id) from events) as early from events)
    select 1::bigint as version, chat_id, event_type, value, event_id from e where early
    qualify row_number() over (partition by chat_id order by event_id desc) = 1
    union all
    select 2, chat_id, event_type, value, event_id from e
    qualify row_number() over (partition by chat_id order by event_id desc) = 1""",
)
def s4_published(t: Tables):
    """Two published saves of a chat table, each version read for itself."""
    saves, early, late = _saves(t)
    table = ChatTable(t.spark, scratch_path(t.spark, "chat-table"), saves.schema)
    first = table.save(early, version=("event_id",))
    second = table.save(late, version=("event_id",))
    of = lambda n: table.read(n).select(F.lit(n).cast("bigint").alias("version"), *saves.columns)
    return of(first).unionByName(of(second))


@query(
    "x7_table_deletes",
    """
    with e as (select cast(user_id as varchar) as chat_id, user_id, event_type, value, event_id from events),
    n as (
      select * from e where user_id % 7 <> 0 qualify row_number() over (partition by chat_id order by event_id desc) = 1),
    again as (
      select * from e where user_id % 14 = 0 and event_type = 'purchase'
      qualify row_number() over (partition by chat_id order by event_id desc) = 1)
    select chat_id, event_type, value, event_id from (select * from n union all select * from again)""",
)
def x7_deletes(t: Tables):
    """Chats saved by one writer, some deleted by a second and some of these saved again by a third, then compacted."""
    saves, early, late = _saves(t)
    path = scratch_path(t.spark, "chat-table")
    writer = ChatTable(t.spark, path, saves.schema)
    writer.save(early, version=("event_id",))
    writer.save(late, version=("event_id",))
    number = F.col("chat_id").cast("bigint")
    ChatTable(t.spark, path, saves.schema).delete(saves.where(number % 7 == 0).select("chat_id"))
    third = ChatTable(t.spark, path, saves.schema)
    third.save(saves.where((number % 14 == 0) & (F.col("event_type") == "purchase")), version=("event_id",))
    third.compact()
    return third.read()
