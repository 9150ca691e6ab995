import random

import pytest
from pyspark.sql import functions as F

from convoframe.operators import chats, messages

MSGS = "chat_id string, turn bigint, role string, content string"


@pytest.fixture
def talk(spark):
    """two questions in a row; a chat that ends on a question; one that opens with a reply."""
    data = [
        ("a", 0, "user", "q0"), ("a", 1, "user", "q1"), ("a", 2, "assistant", "r2"),
        ("b", 0, "system", "be kind"), ("b", 1, "user", "q1"), ("b", 2, "assistant", "r2"),
        ("b", 3, "user", "q3"),
        ("c", 0, "assistant", "hello"), ("c", 1, "user", "q1"), ("c", 2, "system", "note"),
        ("c", 3, "assistant", "r3"),
    ]
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, MSGS)


def long_chat(spark, n=25):
    """One chat that holds most rows, with a gap at 12, among short ones."""
    roles = ["user", "assistant"]
    data = [("hot", t, roles[t % 2], f"m{t}") for t in range(n) if t != 12]
    data += [(f"s{i}", t, roles[t % 2], f"s{i}.{t}") for i in range(4) for t in range(3)]
    random.Random(2).shuffle(data)
    return spark.createDataFrame(data, MSGS), data


def test_pairs(talk, rows):
    pairs = messages.pair_turns(talk).select("chat_id", "turn", "reply_turn", "reply")
    assert rows(pairs) == [
        ("a", 0, None, None), ("a", 1, 2, "r2"), ("b", 1, 2, "r2"), ("b", 3, None, None),
        ("c", 1, None, None),
    ]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_pairs_do_not_depend_on_the_cuts(spark, rows, size):
    msgs, data = long_chat(spark)
    where = {(c, t): (r, x) for c, t, r, x in data}
    expected = sorted(
        [
            (c, t, x, *((t + 1, where[c, t + 1][1]) if where.get((c, t + 1), ("", ""))[0] == "assistant"
                        else (None, None)))
            for c, t, r, x in data if r == "user"
        ],
        key=repr,
    )
    assert rows(messages.pair_turns(msgs, part_size=size)) == expected


def test_context_keeps_order_and_roles(talk):
    found = {
        (r.chat_id, r.turn): [m.content for m in r.history]
        for r in messages.build_context(talk).collect()
    }
    assert found == {
        ("a", 0): [], ("a", 1): ["q0"], ("b", 1): ["be kind"], ("b", 3): ["be kind", "q1", "r2"],
        ("c", 1): ["hello"],
    }


@pytest.mark.parametrize("k", [0, 1, 3, 30])
@pytest.mark.parametrize("size", [1, 4, 100])
def test_bounded_context_does_not_depend_on_the_cuts(spark, k, size):
    msgs, data = long_chat(spark)
    found = {
        (r.chat_id, r.turn): [m.content for m in r.history]
        for r in messages.build_context(msgs, max_turns=k, part_size=size).collect()
    }
    assert found == {
        (c, t): [x for c2, t2, _, x in sorted(data) if c2 == c and t - k <= t2 < t]
        for c, t, r, x in data if r == "user"
    }


@pytest.mark.parametrize("size", [4, 10, 100])
def test_unbounded_context_is_whole(spark, size):
    msgs, data = long_chat(spark)
    ordered = sorted(data)
    for r in messages.build_context(msgs, part_size=size).collect():
        assert [m.content for m in r.history] == [x for c, t, _, x in ordered if c == r.chat_id and t < r.turn]


def test_history_of_a_long_chat_is_whole(spark):
    """2,500 turns at the default sizes, beside short chats."""
    data = [("long", t, "user" if t % 50 == 0 else "assistant", f"m{t}") for t in range(2_500)]
    data += [("short", 0, "user", "a"), ("short", 1, "user", "b"), ("odd", 3, None, "x"), ("odd", 4, "user", "y")]
    msgs = spark.createDataFrame(data, MSGS)
    found = {(r.chat_id, r.turn): [m.content for m in r.history] for r in messages.build_context(msgs).collect()}
    assert found["short", 1] == ["a"] and found["odd", 4] == ["x"]
    assert all(found["long", t] == [f"m{i}" for i in range(t)] for t in range(0, 2_500, 50))
    prompts = {(r.chat_id, r.turn): r.prompt for r in messages.build_prompts(msgs).collect()}
    assert len(prompts["long", 2_450]) == 2_452 and [m.content for m in prompts["odd", 4]][1:] == ["x", "y"]


def test_prompts(spark, talk):
    settings = spark.createDataFrame([("a", "from settings"), ("b", "unused")], "chat_id string, system_prompt string")
    found = {
        (r.chat_id, r.turn): [(m.role, m.content) for m in r.prompt]
        for r in messages.build_prompts(talk, settings).collect()
    }
    assert found["a", 1] == [("system", "from settings"), ("user", "q0"), ("human", "q1")]
    assert found["b", 3] == [
        ("system", "be kind"), ("user", "q1"), ("assistant", "r2"), ("human", "q3")]
    assert found["c", 1][0][1].startswith("You are a helpful")
    per_row = talk.withColumn("system_prompt", F.concat(F.lit("row "), F.col("turn").cast("string")))
    found = {(r.chat_id, r.turn): r.prompt[0].content for r in messages.build_prompts(per_row).collect()}
    assert found == {("a", 0): "row 0", ("a", 1): "row 1", ("b", 1): "be kind", ("b", 3): "be kind",
                     ("c", 1): "row 1"}


@pytest.mark.parametrize("size", [2, 5])
def test_prompts_of_long_chats_keep_their_system_row(spark, size):
    data = [("hot", 0, "system", "rule")] + [("hot", t, "user", f"m{t}") for t in range(1, 12)]
    found = messages.build_prompts(spark.createDataFrame(data, MSGS), part_size=size).collect()
    assert len(found) == 11
    for r in found:
        inline = [f"m{t}" for t in range(1, r.turn)]
        assert [m.content for m in r.prompt] == ["rule", *inline, f"m{r.turn}"]


@pytest.mark.parametrize("size", [3, 100])
def test_fold_then_load_is_the_same(spark, talk, rows, size):
    folded = chats.fold_messages(talk, size)
    back = chats.explode_chats(folded)
    assert rows(back.select("chat_id", "turn", "role", "content")) == rows(talk)


def test_transcript_in_order(talk):
    found = {r.chat_id: r.transcript for r in chats.render_transcript(talk).collect()}
    assert found["b"] == "system: be kind\nuser: q1\nassistant: r2\nuser: q3"
    marked = {r.chat_id: r.transcript for r in chats.render_transcript(talk, "markdown").collect()}
    assert marked["a"].startswith("**user**\n\nq0\n\n**user**\n\nq1")
    with pytest.raises(ValueError):
        chats.render_transcript(talk, "pdf")


def test_upsert_replaces_and_is_idempotent(spark, rows):
    """the newer version has fewer messages."""
    kind = "chat_id string, chat_name string, messages array<string>, v int"
    base = spark.createDataFrame([("a", "one", ["x", "y"], 1), ("b", "b", [], 1)], kind)
    new = spark.createDataFrame([("a", None, ["x"], 2), ("c", "c", [], 1)], kind)
    once = chats.upsert_chats(base, new, "v")
    assert rows(once) == [("a", None, ["x"], 2), ("b", "b", [], 1), ("c", "c", [], 1)]
    assert rows(chats.upsert_chats(once, new, "v")) == rows(once)


def test_upsert_limits_rows_before_the_shuffle(spark):
    rows = spark.range(100).select(F.lit("hot").alias("chat_id"), F.col("id").alias("v"))
    plan = chats.upsert_chats(rows, rows, "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_delete_and_unknown_ids(spark, rows):
    """F4."""
    base = spark.createDataFrame([("a",), ("b",)], "chat_id string")
    gone = spark.createDataFrame([("b",), ("z",), ("z",)], "chat_id string")
    assert rows(chats.delete_chats(base, gone)) == [("a",)]
    assert rows(chats.missing_ids(base, gone)) == [("z",)]


def test_titles(spark, rows):
    """F14, and that a name is only given once."""
    first = [("1", "2024 12"), ("2", "?!"), ("3", "hello"), ("4", "ßa b"),
             ("5", "What's the BEST way, in 2024, to sort lists quickly?")]
    msgs = spark.createDataFrame(
        [(c, 1, "user", x) for c, x in first] + [("5", 2, "user", "later"), ("5", 0, "system", "s")], MSGS)
    assert dict(rows(chats.title_chats(msgs))) == {
        "1": None, "2": None, "3": "Hello", "4": "Ssa B", "5": "What S The Best Way"}
    names = spark.createDataFrame([("3", "Kept"), ("4", ""), ("5", None)], "chat_id string, chat_name string")
    assert dict(rows(chats.title_chats(msgs, names))) == {
        "1": None, "2": None, "3": "Kept", "4": "Ssa B", "5": "What S The Best Way"}


def test_title_check(spark):
    names = ["Good Title", "One", "a Lower Case", "Too Many Words In This Title", "With 2024 Date", "What?", None, " "]
    found = chats.check_titles(spark.createDataFrame([(n,) for n in names], "chat_name string")).collect()
    assert [r.reasons for r in found] == [
        [], ["word_count"], ["capitals"], ["word_count"], ["digits"],
        ["word_count", "special_characters"], ["missing"], ["missing"]]


def test_message_validation(spark):
    """F6."""
    data = [("user", None), ("user", ""), ("user", "   "), ("user", "x"), ("tool", "x"), (None, "x")]
    found = messages.validate_messages(spark.createDataFrame(data, "role string, content string"))
    assert [r.reason for r in found.collect()] == [
        "missing_content", "empty_content", None, None, "unknown_role", "unknown_role"]


@pytest.mark.parametrize("limit", [40, 1])
def test_numbering_does_not_depend_on_the_cuts(spark, rows, limit):
    msgs, data = long_chat(spark)
    seen: dict = {}
    expected = []
    for c, t, r, x in sorted(data):
        expected.append((c, r, x, seen.setdefault(c, 0)))
        seen[c] += 1
    assert rows(messages.number_turns(msgs, partitions=limit)) == sorted(expected, key=repr)


def test_append_responses(spark, rows):
    msgs = spark.createDataFrame([("a", 0, "user", "q"), ("b", 0, "user", "q")], MSGS)
    replies = spark.createDataFrame(
        [("a", 0, "r", None), ("a", 0, "s", None), ("none", 0, "r", None), ("b", 0, None, "Broken: x"), ("b", 7, "r", None)],
        "chat_id string, turn long, response string, error string")
    appended, rejected = messages.append_responses(msgs, replies)
    assert rows(appended) == [("a", 0, "user", "q"), ("a", 1, "assistant", "r"), ("b", 0, "user", "q")]
    assert sorted((r.chat_id, r.turn, r.reason) for r in rejected.collect()) == [
        ("a", 0, "repeated"), ("b", 0, "failed"), ("b", 7, "unknown_turn"), ("none", 0, "unknown_turn")]


def test_answers_go_back_into_the_chat(spark):
    """Generated rows are appended as they are, each after its own question."""
    from convoframe.operators import generate

    msgs = spark.createDataFrame(
        [("a", 0, "user", "q0"), ("a", 1, "user", "q1"), ("a", 2, "assistant", "old")], MSGS
    ).withColumn("model", F.lit("m")).withColumn("temperature", F.lit(0.5))

    def make():
        return lambda prompt, model, temperature: f"{model} {temperature} {prompt[-1]['content']}"

    answers = generate.batch_generate(messages.build_prompts(msgs), make, with_columns=("model", "temperature"))
    assert answers.columns == ["chat_id", "turn", "model", "temperature", "response", "error"]
    appended, rejected = messages.append_responses(msgs, answers)
    found = [(r.turn, r.role, r.content) for r in appended.orderBy("turn").collect()]
    assert found == [(0, "user", "q0"), (1, "assistant", "m 0.5 q0"), (2, "user", "q1"), (3, "assistant", "m 0.5 q1"),
                     (4, "assistant", "old")]
    assert rejected.count() == 0


def test_numbering_by_text_and_date(spark):
    data = [("a", "x", "2024-01-02"), ("a", "b", "2024-01-03"), ("a", "m", "2024-01-01")]
    df = spark.createDataFrame(data, "chat_id string, name string, day string").withColumn("day", F.to_date("day"))
    assert {r.name: r.turn for r in messages.number_turns(df, "name").collect()} == {"b": 0, "m": 1, "x": 2}
    assert {r.name: r.turn for r in messages.number_turns(df, "day").collect()} == {"m": 0, "x": 1, "b": 2}


def test_collisions(spark, rows):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "chat_id string")
    assert rows(chats.id_collisions(df)) == [("a", 2)]
