import random

import pytest
from pyspark.sql import functions as F

from convoframe.sources.chat_table import ChatTable, Conflict

ROWS = "chat_id string, n long"


def table(spark, path, schema=ROWS, **options):
    return ChatTable(spark, str(path), schema, buckets=4, **options)


def chats(spark, *rows, schema=ROWS):
    return spark.createDataFrame(list(rows), schema)


def held(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_saves_replace_and_readers_keep_their_snapshot(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.version() == 0 and held(t.read()) == []
    assert t.save(chats(spark, ("a", 1), ("b", 2))) == 1
    reader = t.read()
    assert t.save(chats(spark, ("b", 3), ("c", 4))) == 2
    assert held(reader) == held(t.read(1)) == [("a", 1), ("b", 2)]
    assert held(t.read()) == [("a", 1), ("b", 3), ("c", 4)]
    assert [(s["version"], s["parent"], s["operation"]) for s in t.history()] == [(1, 0, "save"), (2, 1, "save")]


def test_a_save_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path / "t")
    t.save(chats(spark, ("a", 1), ("b", 2)))
    broken = table(spark, tmp_path / "t")
    for step in ("_write_rows", "_holding", "_publish"):
        with monkeypatch.context() as patch:
            done = getattr(broken, step)

            def dies(*args, done=done, step=step, **kwargs):
                if step != "_publish":
                    done(*args, **kwargs)
                raise OSError("the writer is gone")

            patch.setattr(broken, step, dies)
            with pytest.raises(OSError):
                broken.save(chats(spark, ("a", 9), ("z", 9)))
        assert t.version() == 1 and held(t.read()) == [("a", 1), ("b", 2)]
    bad = chats(spark, ("a", 5)).withColumn("n", F.raise_error(F.lit("no")).cast("long"))
    with pytest.raises(Exception, match="no"):
        t.save(bad)
    assert t.version() == 1 and held(t.read()) == [("a", 1), ("b", 2)]


def test_of_two_writers_one_is_refused(spark, tmp_path):
    one, two = table(spark, tmp_path / "t"), table(spark, tmp_path / "t")
    one.save(chats(spark, ("a", 1)))
    base = two.version()
    one.save(chats(spark, ("a", 2)), parent=base)
    for late in (lambda: two.save(chats(spark, ("a", 3)), parent=base), lambda: two.delete(chats(spark, ("a", 0)), parent=base)):
        with pytest.raises(Conflict):
            late()
    assert held(two.read()) == [("a", 2)]
    assert two.save(chats(spark, ("a", 3))) == 3 and held(one.read()) == [("a", 3)]


def test_a_run_publishes_a_batch_once(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.save(chats(spark, ("a", 1)), run="r", batch=0) == 1
    assert t.save(chats(spark, ("b", 1)), run="r", batch=1) == 2
    assert t.save(chats(spark, ("b", 9)), run="r", batch=1) == 2
    assert t.save(chats(spark, ("b", 2)), run="other", batch=0) == 3
    assert held(t.read()) == [("a", 1), ("b", 2)]


def test_rows_without_a_key_are_refused(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    with pytest.raises(ValueError, match="chat_id"):
        t.save(chats(spark, ("a", 1), (None, 2)))
    assert t.version() == 0
    with pytest.raises(ValueError):
        table(spark, tmp_path / "u", "chat_id string, _bucket int")


def test_versions_within_a_save_and_empty_commits(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.save(chats(spark, ("a", 1), ("a", 3), ("a", 2)), version=("n",))
    assert held(t.read()) == [("a", 3)]
    t.save(chats(spark))
    t.delete(chats(spark).select("chat_id"))
    assert t.version() == 3 and held(t.read()) == [("a", 3)]
    assert held(t.missing(chats(spark, ("a", 0), ("q", 0)))) == [("q",)]
    t.delete(chats(spark, ("a", 0), ("q", 0)))
    assert held(t.read()) == []


def test_chats_in_parts_and_clashing_columns(spark, tmp_path):
    """A save with fewer parts leaves none of the old ones; columns may be named like the table's own parts."""
    schema = "chat_id string, part int, file string, rows long, least string, touched boolean"
    t = table(spark, tmp_path / "t", schema)
    t.save(chats(spark, ("a", 0, "f", 1, "l", True), ("a", 1, "f", 1, "l", True), ("b", 0, "f", 1, "l", None), schema=schema))
    t.save(chats(spark, ("a", 0, "g", 2, None, False), schema=schema))
    assert held(t.read()) == [("a", 0, "g", 2, None, False), ("b", 0, "f", 1, "l", None)]
    t.compact()
    assert held(t.read()) == [("a", 0, "g", 2, None, False), ("b", 0, "f", 1, "l", None)]


def files(t, version=None):
    return {r["file"] for r in t.manifest(t.snapshot(version)).collect()}


def test_compaction_rewrites_worn_files_only(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.save(spark.range(400).selectExpr("cast(id as string) as chat_id", "id as n"))
    before = files(t)
    t.delete(chats(spark, ("7", 0), ("unknown", 0)))
    worn = {r["_file"] for r in t._tombs(t.snapshot()).collect()}
    assert len(before) == 4 and len(worn) == 1
    rows = held(t.read())
    assert len(rows) == 399
    t.compact()
    after = files(t)
    assert before - after == worn and before & after == before - worn
    assert held(t.read()) == rows and t.snapshot()["tombs"] == []
    assert held(t.read(2)) == rows and len(held(t.read(1))) == 400
    assert t.compact() == 3
    t.compact(small=1_000)
    assert held(t.read()) == rows


def test_clean_files_are_not_joined(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.save(spark.range(100).selectExpr("cast(id as string) as chat_id", "id as n"))
    assert "Join" not in t.read()._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("seed", range(3))
def test_saves_and_deletes_equal_brute_force(spark, tmp_path, seed):
    """Three writers in turn, saving and deleting, with one key that has a third of all rows."""
    draw = random.Random(seed)
    path, expected, seen = tmp_path / "t", {}, []
    for step in range(9):
        t = table(spark, path, "chat_id string, turn long, text string")
        ids = draw.sample("abcdefghij", 4)
        if step % 3 == 2:
            t.delete(spark.createDataFrame([(i,) for i in [*ids, "none"]], "chat_id string"))
            for i in ids:
                expected.pop(i, None)
        else:
            rows = [(i, k, f"{step}") for i in ids for k in range(draw.randrange(1, 40 if i == ids[0] else 4))]
            t.save(spark.createDataFrame(rows, "chat_id string, turn long, text string"))
            expected |= {i: [r for r in rows if r[0] == i] for i in ids}
        if step == 5:
            t.compact(small=5)
        now = sorted((r for rows in expected.values() for r in rows), key=repr)
        seen.append((t.version(), now))
        assert held(t.read()) == now
    for version, rows in seen:
        assert held(table(spark, path, "chat_id string, turn long, text string").read(version)) == rows


def test_message_keys_of_two_columns(spark, tmp_path):
    schema = "chat_id string, turn long, text string"
    t = ChatTable(spark, str(tmp_path / "t"), schema, keys=("chat_id", "turn"), buckets=3)
    t.save(chats(spark, ("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z"), schema=schema))
    t.save(chats(spark, ("a", 1, "new"), schema=schema))
    t.delete(chats(spark, ("b", 0, ""), schema=schema))
    assert held(t.read()) == [("a", 0, "x"), ("a", 1, "new")]
