import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoframe import schemas
from convoframe.operators import chats
from convoframe.operators.chats import explode_chats, list_chats, load_chat, migrate_legacy
from convoframe.sources import chat_log
from convoframe.sources.chats import (
    export_chats,
    read_chats,
    read_corpus,
    split_bad_chats,
    write_chats,
)

# A document without the number of its part.
DOC = T.StructType(schemas.CHAT.fields[:3])

GOOD = {
    "chat_id": "a",
    "chat_name": "Test Chat",
    "messages": [{"role": "user", "content": "Hello"}, {"role": "assistant", "content": "Hi there!"}],
}


@pytest.fixture
def folder(tmp_path):
    """a good, a cut-off and an old document, and a file of another kind."""
    (tmp_path / "a.json").write_text(json.dumps(GOOD, indent=2), encoding="utf-8")
    (tmp_path / "b.json").write_text('{"chat_id": "b", ', encoding="utf-8")
    (tmp_path / "chat_x.json").write_text(json.dumps({"id": "chat_x", "name": "old", "messages": []}))
    (tmp_path / "c.txt").write_text(json.dumps({**GOOD, "chat_id": "c"}))
    return str(tmp_path)


def test_read_skips_other_files_and_keeps_bad_ones(spark, folder):
    good, bad = split_bad_chats(read_chats(spark, folder))
    assert [r.chat_id for r in good.collect()] == ["a"]
    assert good.first().source_file.endswith("a.json")
    found = {os.path.basename(r.source_file): r.reason for r in bad.collect()}
    assert found == {"b.json": "malformed", "chat_x.json": "no_chat_id"}


def test_strict_read_raises(spark, folder):
    with pytest.raises(Exception, match="(?i)malformed"):
        read_chats(spark, folder, strict=True).collect()


def test_listing_of_two_files(spark, tmp_path, rows):
    for chat, name in (("123", "Chat 1"), ("456", "Chat 2")):
        (tmp_path / f"{chat}.json").write_text(
            json.dumps({"chat_id": chat, "chat_name": name, "messages": []})
        )
    good, bad = split_bad_chats(read_chats(spark, str(tmp_path)))
    assert rows(list_chats(good)) == [("123", "Chat 1"), ("456", "Chat 2")]
    assert bad.count() == 0


def test_old_documents_migrate(spark, folder, rows):
    old = read_chats(spark, folder, legacy=True).where(F.col(schemas.CORRUPT).isNull())
    assert rows(migrate_legacy(old).select("chat_id", "chat_name")) == [
        ("a", "Test Chat"),
        ("x", "old"),
    ]


ODD = [
    ("20240101_000000", None, [("user", "Grüße\nzweite Zeile"), ("assistant", '"{}" 🤖')]),
    ("20240102_000000", "", []),
    ("other", "n", [("user", None)]),
]


@pytest.mark.parametrize("fmt", ["json", "parquet"])
@pytest.mark.parametrize("partition_by", [None, "chat_day"])
def test_write_and_read_back(spark, tmp_path, rows, fmt, partition_by):
    """null name, empty messages, other alphabets and line ends in texts."""
    path = str(tmp_path / "out")
    odd = spark.createDataFrame(ODD, DOC)
    write_chats(odd, path, fmt, partition_by)
    if fmt == "json":
        back, bad = split_bad_chats(read_chats(spark, path, lines=True))
        assert bad.count() == 0
    else:
        back = spark.read.parquet(path)
    columns = odd.columns
    assert rows(back.select(columns)) == rows(odd)
    if partition_by:
        days = {name for name in os.listdir(path) if name.startswith("chat_day=")}
        assert days == {"chat_day=20240101", "chat_day=20240102", "chat_day=other"}


def test_json_keeps_null_names(spark, tmp_path):
    path = str(tmp_path / "out")
    write_chats(spark.createDataFrame(ODD[:1], DOC), path, "json")
    (line,) = [r.value for r in spark.read.text(path).collect()]
    assert json.loads(line)["chat_name"] is None


def test_load_chooses_by_list_or_table(spark, rows):
    chats = spark.createDataFrame(ODD, DOC)
    wanted = [("20240101_000000", None, 0, "user", "Grüße\nzweite Zeile"),
              ("20240101_000000", None, 1, "assistant", '"{}" 🤖')]
    assert rows(load_chat(chats, ["20240101_000000"])) == sorted(wanted, key=repr)
    table = spark.createDataFrame([("20240101_000000",), ("none",)], "chat_id string")
    assert rows(load_chat(chats, table)) == sorted(wanted, key=repr)
    assert explode_chats(chats).count() == 3


def test_load_by_list_is_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "chats")
    write_chats(spark.createDataFrame(ODD, DOC), path)
    chats = spark.read.parquet(path)
    plan = load_chat(chats, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(chat_id" in plan
    listed = list_chats(chats)._jdf.queryExecution().executedPlan().toString()
    assert "messages" not in listed


def test_batches_newest_row_and_repeat(spark, tmp_path, rows):
    path, compacted = str(tmp_path / "log"), str(tmp_path / "compact")
    schema = "chat_id string, chat_name string, n int"

    def batch(*data):
        return spark.createDataFrame(data, schema)

    chat_log.write_batch(batch(("a", "one", 1), ("b", "one", 1)), path, 0)
    chat_log.write_batch(batch(("a", "two", 2), ("c", "two", 2)), path, 1)
    chat_log.write_batch(batch(("a", "two", 2), ("c", "two", 2)), path, 1)
    chat_log.write_batch(batch(("c", "ten", 0)), path, 10)
    expected = [("a", "two", 2), ("b", "one", 1), ("c", "ten", 0)]
    types = batch(("a", "", 0)).schema
    assert rows(chat_log.read_current(spark, path, types)) == expected
    chat_log.compact(spark, path, compacted, types)
    chat_log.write_batch(batch(("b", "new", 5)), compacted, 1)
    assert rows(chat_log.read_current(spark, compacted, types)) == [
        ("a", "two", 2), ("b", "new", 5), ("c", "ten", 0)]


def test_runs_do_not_replace_each_other(spark, tmp_path, rows):
    path = str(tmp_path / "log")
    schema = "chat_id string, n int"
    batch = lambda *data: spark.createDataFrame(data, schema)
    chat_log.write_batch(batch(("a", 1), ("b", 1)), path, 0, "first")
    chat_log.write_batch(batch(("a", 2)), path, 1, "first")
    chat_log.write_batch(batch(("b", 3)), path, 0, "second")
    types = batch(("a", 0)).schema
    assert rows(chat_log.read_current(spark, path, types)) == [("a", 2), ("b", 3)]


def test_a_long_chat_goes_whole_through_the_store(spark, tmp_path, rows):
    """25,000 messages: written, read, loaded, upserted, listed, titled, logged and exported."""
    n = 25_000
    msgs = spark.range(n).selectExpr(
        "'long' as chat_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('m', id) as content")
    msgs = msgs.unionByName(spark.createDataFrame([("short", 0, "user", "hi")], msgs.schema))
    docs = chats.fold_messages(msgs).withColumn("chat_name", F.when(F.col("chat_id") == "short", "Named"))
    want = rows(msgs.select("chat_id", "turn", "role", "content"))
    for fmt in ("json", "parquet"):
        path = str(tmp_path / fmt)
        write_chats(docs, path, fmt)
        back = read_chats(spark, path, lines=True) if fmt == "json" else spark.read.parquet(path)
        assert rows(chats.explode_chats(back).select("chat_id", "turn", "role", "content")) == want
        assert rows(list_chats(back)) == [("long", None), ("short", "Named")]
        assert load_chat(back, ["long"]).count() == n
        saved = back.withColumn("v", F.lit(1))
        assert rows(chats.explode_chats(chats.upsert_chats(saved, saved.limit(0), "v")).select(
            "chat_id", "turn", "role", "content")) == want
        # A newer, shorter save takes all parts of the older one away.
        newer = chats.fold_messages(msgs.where("chat_id = 'long' and turn < 12000"))
        newer = newer.withColumn("chat_name", F.lit("New")).withColumn("v", F.lit(2))
        current = chats.upsert_chats(saved.select(newer.columns), newer, "v")
        assert chats.explode_chats(current).count() == 12_001 and current.count() == 3
    titled = chats.title_chats(msgs, docs)
    assert rows(titled) == [("long", "M0"), ("short", "Named")]
    path = str(tmp_path / "log")
    chat_log.write_batch(docs, path, 0)
    current = chat_log.read_current(spark, path, docs.schema)
    assert rows(chats.explode_chats(current).select("chat_id", "turn", "role", "content")) == want
    path = str(tmp_path / "export")
    export_chats(msgs, path)
    lines = []
    for file in sorted(p for p in (tmp_path / "export").rglob("part-*")):
        lines += file.read_text().split("\n")
    said = [line for line in lines if line.startswith("m")]
    assert said == [f"m{i}" for i in range(n)]
    assert [line for line in lines if line.startswith("# ")] == ["# long", "# long, part 2", "# long, part 3", "# short"]


def test_a_chat_whose_first_part_is_gone_is_listed(spark, rows):
    docs = spark.createDataFrame([("a", 2, "x"), ("a", 3, "y")], "chat_id string, part long, chat_name string")
    assert rows(list_chats(docs)) == [("a", "x")]


def test_bad_rows_are_parsed_once(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    (path / "a.json").write_text('{"chat_id": "a", "messages": []}')
    (path / "b.json").write_text("{")
    good, bad = split_bad_chats(read_chats(spark, str(path)))
    for df in (good, bad):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "json" not in plan.lower() and "parquet" in plan.lower()
        assert df.count() == 1


def test_export_writes_markdown_by_day(spark, tmp_path):
    path = str(tmp_path / "export")
    msgs = spark.createDataFrame(
        [("20240101_000000", 1, "assistant", "Hi"), ("20240101_000000", 0, "user", "Hello")],
        "chat_id string, turn bigint, role string, content string",
    )
    export_chats(msgs, path)
    (part,) = [n for n in os.listdir(f"{path}/chat_day=20240101") if n.endswith(".txt")]
    with open(f"{path}/chat_day=20240101/{part}", encoding="utf-8") as f:
        assert f.read().strip() == "# 20240101_000000\n\n**user**\n\nHello\n\n**assistant**\n\nHi"


def test_corpus_from_text_and_csv(spark, tmp_path, rows):
    (tmp_path / "texts").mkdir()
    (tmp_path / "texts" / "one.txt").write_text("first line\nsecond line", encoding="utf-8")
    (doc,) = read_corpus(spark, str(tmp_path / "texts")).collect()
    assert doc.doc_id.endswith("one.txt") and doc.text == "first line\nsecond line"
    (tmp_path / "docs.csv").write_text('doc_id,text\n1,"a ""quoted"" text\nover lines"\n2, plain \n')
    csv = read_corpus(spark, str(tmp_path / "docs.csv"), "csv")
    assert rows(csv) == [("1", 'a "quoted" text\nover lines'), ("2", " plain ")]
    with pytest.raises(ValueError):
        read_corpus(spark, str(tmp_path), "pdf")
