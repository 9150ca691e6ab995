"""Runs that take up earlier ones: generation by its ledger, intake of files, sketches of parts."""

import json
import os
import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoframe.operators.generation_ledger import read_ledger, resume_generate
from convoframe.operators.sketches import bucket_of, merge_sketches, quantile_sketch, sketch_quantiles
from convoframe.sources import intake
from convoframe.sources.intake import new_files, read_taken, take_in

PROMPTS = "chat_id string, turn int, prompt array<struct<role: string, content: string>>"


def model_factory(folder, fatal=(), failing=()):
    """Notes each call as a file of its own; ends the task, or fails, on some prompts."""

    class Killed(BaseException):
        """What no operator may catch; in here, as workers don't import this module."""

    def make():
        def model(prompt):
            said = prompt[-1]["content"]
            if said in fatal:
                raise Killed(said)
            with open(os.path.join(folder, f"{said}.{uuid.uuid4().hex}"), "w"):
                pass
            if said in failing:
                raise failing[said]("no answer")
            return said.upper()

        return model

    return make


def calls(folder):
    out = {}
    for name in os.listdir(folder):
        said = name.split(".")[0]
        out[said] = out.get(said, 0) + 1
    return out


@pytest.fixture
def notes(tmp_path):
    def new(name):
        (tmp_path / name).mkdir()
        return str(tmp_path / name)

    return new


def prompts(spark, said):
    return spark.createDataFrame([(f"c{i}", i, [("user", s)]) for i, s in enumerate(said)], PROMPTS)


def test_killed_run_keeps_finished_tasks(spark, notes, tmp_path):
    said = [f"p{i}" for i in range(60)]
    ledger, first, second = str(tmp_path / "ledger"), notes("first"), notes("second")
    with pytest.raises(Exception, match="Killed"):
        resume_generate(prompts(spark, said), model_factory(first, fatal=("p7",)), ledger, calls_per_task=3)
    noted = {r.response.lower() for r in read_ledger(spark, ledger).collect()}
    assert noted and "p7" not in noted
    found = resume_generate(prompts(spark, said), model_factory(second), ledger, calls_per_task=3)
    assert {r.chat_id: r.response for r in found.collect()} == {f"c{i}": f"P{i}" for i in range(60)}
    assert calls(second) == {s: 1 for s in said if s not in noted}
    again = notes("again")
    assert resume_generate(prompts(spark, said), model_factory(again), ledger).count() == 60
    assert calls(again) == {}


def test_equal_prompts_are_called_once_and_failures_to_their_limit(spark, notes, tmp_path):
    ledger, folder = str(tmp_path / "ledger"), notes("calls")
    rows = prompts(spark, ["same"] * 40 + ["slow", "odd", "other"])
    rows = rows.withColumn("digest", F.lit("mine")).union(rows.limit(1).withColumn("digest", F.lit(None)))
    make = model_factory(folder, failing={"slow": TimeoutError, "odd": ValueError})
    found = resume_generate(rows, make, ledger, {"TimeoutError": 3}).collect()
    assert calls(folder) == {"same": 1, "slow": 3, "odd": 1, "other": 1}
    assert len(found) == 44 and sum(r.response == "SAME" for r in found) == 41
    assert {r.error for r in found} == {None, "TimeoutError: no answer", "ValueError: no answer"}
    # A higher limit opens the prompt again; an answer then counts.
    found = resume_generate(rows, model_factory(folder), ledger, {"TimeoutError": 4}).collect()
    assert calls(folder) == {"same": 1, "slow": 4, "odd": 1, "other": 1}
    assert {r.response for r in found} == {"SAME", "SLOW", "OTHER", None}


def test_generation_of_nothing(spark, notes, tmp_path):
    ledger, folder = str(tmp_path / "ledger"), notes("calls")
    rows = spark.createDataFrame([(None, None, None), (None, None, [])], PROMPTS)
    assert resume_generate(rows.limit(0), model_factory(folder), ledger).count() == 0
    found = resume_generate(rows, model_factory(folder), ledger).collect()
    assert len(found) == 2 and all(r.error and r.response is None for r in found)
    with pytest.raises(ValueError):
        resume_generate(rows, model_factory(folder), ledger, {"*": 0})


def save(folder, name, seconds, **fields):
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8") as out:
        out.write(fields.get("raw") or json.dumps(fields, indent=2))
    os.utime(path, (seconds, seconds))


def test_intake_reads_only_what_is_new(spark, notes, tmp_path):
    folder, table, ledger = notes("chats"), str(tmp_path / "table"), str(tmp_path / "files")
    message = [{"role": "user", "content": "Grüße\nzwei"}]
    for i in range(5):
        save(folder, f"{i}.json", 1_000 + i, chat_id=f"c{i}", chat_name="one", messages=message)
    save(folder, "bad.json", 2_000, raw='{"chat_id": "x", ')
    save(folder, "none.json", 2_000, chat_id="y")
    save(folder, "other.txt", 2_000, chat_id="z", messages=message)
    bad = take_in(spark, folder, table, ledger).collect()
    assert {(os.path.basename(r.source_file), r.reason) for r in bad} == {("bad.json", "malformed"), ("none.json", "no_messages")}
    assert new_files(spark, folder, ledger).count() == 0
    assert take_in(spark, folder, table, ledger).count() == 0

    # Changed, new, and repaired files; a copy that is older than all that was read; another file of one chat.
    save(folder, "1.json", 3_000, chat_id="c1", chat_name="two", messages=[])
    save(folder, "bad.json", 3_000, chat_id="x", chat_name="whole", messages=message)
    save(folder, "old.json", 10, chat_id="c9", chat_name="old", messages=message)
    save(folder, "late.json", 9_000, chat_id="c2", chat_name="late", messages=message)
    save(folder, "early.json", 20, chat_id="c3", chat_name="early", messages=message)
    names = {os.path.basename(r.path) for r in new_files(spark, folder, ledger).collect()}
    assert names == {"1.json", "bad.json", "old.json", "late.json", "early.json"}
    assert take_in(spark, folder, table, ledger).count() == 0
    taken = {r.chat_id: (r.chat_name, [tuple(m) for m in r.messages]) for r in read_taken(spark, table).collect()}
    said = [("user", "Grüße\nzwei")]
    assert taken == {
        "c0": ("one", said), "c1": ("two", []), "c2": ("late", said), "c3": ("one", said), "c4": ("one", said),
        "x": ("whole", said), "c9": ("old", said)}


def test_lost_intake_is_repeated(spark, notes, tmp_path):
    """The table was written, the ledger was not."""
    folder, table = notes("chats"), str(tmp_path / "table")
    save(folder, "a.json", 1_000, chat_id="a", chat_name="one", messages=[])
    for run in range(2):
        take_in(spark, folder, table, str(tmp_path / f"files-{run}"))
    assert [(r.chat_id, r.chat_name) for r in read_taken(spark, table).collect()] == [("a", "one")]


def test_intake_of_an_empty_folder(spark, notes, tmp_path):
    folder, table, ledger = notes("chats"), str(tmp_path / "table"), str(tmp_path / "files")
    assert take_in(spark, folder, table, ledger).count() == 0
    assert not os.path.exists(table) and not os.path.exists(ledger)


def test_sketches_of_parts_merge_to_that_of_the_whole(spark, rows):
    draw = random.Random(5)
    values = [int(draw.paretovariate(0.4)) for _ in range(4_000)] + [0, 1, -1, -70_000, 2**62, None]
    data = spark.createDataFrame([(i % 24, "k" if i % 3 else None, v) for i, v in enumerate(values)], "h int, k string, v long")
    key = {"k": F.col("k")}
    parts = quantile_sketch(data, {"h": F.col("h"), **key}, F.col("v"))
    whole = quantile_sketch(data, key, F.col("v"))
    merged = merge_sketches(parts, key)
    assert rows(merged) == rows(whole)
    shares = {"low": 0.01, "mid": 0.5, "high": 0.99, "most": 1.0}
    found = {r.k: r for r in sketch_quantiles(merged, ("k",), shares).collect()}
    for k in ("k", None):
        own = sorted(v for i, v in enumerate(values) if v is not None and ("k" if i % 3 else None) == k)
        assert found[k].n == len(own)
        for name, share in shares.items():
            exact, got = own[-int(-share * len(own) // 1) - 1], found[k][name]
            assert abs(got) <= abs(exact) and abs(exact - got) <= abs(exact) / 128, (name, exact, got)
    assert sketch_quantiles(whole.limit(0), ("k",), shares).count() == 0


def test_bucket_of_small_numbers_is_the_number(spark):
    frame = spark.createDataFrame([(v,) for v in (0, 1, 255, 256, 257, -257)], T.StructType([T.StructField("v", T.LongType())]))
    assert [r[0] for r in frame.select(bucket_of(F.col("v"))).collect()] == [0, 1, 255, 256, 256, -256]


def test_a_run_lists_the_folder_once(spark, tmp_path, monkeypatch):
    """However many files it holds; files of one folder that hold the same chat are taken as its saves."""
    folder, table, ledger = (str(tmp_path / n) for n in ("saved", "table", "files"))
    listed = []
    whole = intake._files
    monkeypatch.setattr(intake, "_files", lambda *args: listed.append(args) or whole(*args))
    for run, name in ((1, "draft"), (2, "done")):
        (tmp_path / "saved").mkdir(exist_ok=True)
        path = tmp_path / "saved" / f"part-{run}.json"
        path.write_text('{"chat_id": "a", "chat_name": "%s", "messages": []}' % name)
        os.utime(path, (1_700_000_000 + run, 1_700_000_000 + run))
        intake.take_in(spark, folder, table, ledger)
        assert len(listed) == run
    assert [(r.chat_id, r.chat_name) for r in intake.read_taken(spark, table).collect()] == [("a", "done")]
