from types import SimpleNamespace

import pytest

from convoframe import session
from convoframe.session import materialise, scratch_path, shared_dir


def fake(master, conf, checkpoint=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=conf.get, set=conf.__setitem__),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoint),
    )


def test_the_named_folder_is_used():
    assert shared_dir(fake("yarn", {"spark.checkpoint.dir": "hdfs:///shared/"})) == "hdfs:///shared"
    assert shared_dir(fake("yarn", {}, "hdfs:///other")) == "hdfs:///other"


@pytest.mark.parametrize("master", ["yarn", "local[2]"])
def test_a_shared_folder_must_be_named(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(fake(master, {}))


def test_materialised_rows_come_from_files(spark, rows):
    df = spark.range(5).selectExpr("id", "cast(null as string) as s")
    written = materialise(df, "numbers")
    assert rows(written) == rows(df) and written.dtypes == df.dtypes
    assert written.inputFiles()[0].split(":", 1)[1].lstrip("/").startswith(shared_dir(spark).lstrip("/"))
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_released_tables_go_but_those_still_read(spark):
    with session.scratch_paths() as made:
        one = session.materialise(spark.range(3), "one")
        two = session.materialise(spark.range(5), "two")
    other = session.materialise(spark.range(7), "other")
    assert len(made) == 2
    session.release(spark, made, keep=two)
    assert two.count() == 5 and other.count() == 7
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        one.count()
