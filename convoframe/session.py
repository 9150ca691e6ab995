"""Session settings and the shared folder for data that a job hands to its next stage."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "convoframe", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are planned for.

    Shuffle partitions are left to the caller and AQE: give ``spark.sql.shuffle.partitions`` about
    2-3x the cluster's cores and let AQE merge the small ones.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Streams with timers (T2) need this state store.
        STATE_STORE: ROCKSDB,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


# The scratch tables of this process are in a folder of their own.
_RUN = uuid.uuid4().hex


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/convoframe/{_RUN}"


# The scratch paths that this process has made, in order.
_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; never one that another run reads."""
    path = f"{_run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


@contextlib.contextmanager
def scratch_paths() -> Iterator[list[str]]:
    """The scratch paths that are made within, listed at its end; for ``release``."""
    before, made = len(_made), []
    yield made
    made += _made[before:]


def release(spark: SparkSession, paths: list[str], keep: DataFrame | None = None) -> None:
    """Removes scratch tables once what was made from them is written. Those that ``keep`` reads stay."""
    read = keep.inputFiles() if keep is not None else []
    for path in paths:
        if not any(path.split("://")[-1] in file for file in read):
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cleanup(spark: SparkSession) -> None:
    """Removes this process's scratch tables. Results that were not written yet can't be read after it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# Called with every DataFrame that is written as an intermediate table, for tests that look at plans.
observers: list[Callable[[DataFrame], None]] = []


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    for see in observers:
        see(df)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class _TextFiles:
    """Small text files through Spark's own file systems, from the driver."""

    def __init__(self, spark: SparkSession):
        self.jvm = spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _open(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        """The names in a folder; none if it is not there."""
        where, store = self._open(folder)
        if not store.exists(where):
            return []
        return [status.getPath().getName() for status in store.listStatus(where)]

    def read(self, path: str) -> str:
        where, store = self._open(path)
        stream = store.open(where)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Puts a whole file in place at once, unless there is one of that name: False then."""
        where, store = self._open(path)
        draft = self.jvm.org.apache.hadoop.fs.Path(where.getParent(), f".{uuid.uuid4().hex}.draft")
        out = store.create(draft, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), self.conf)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        options[0] = rename.NONE
        try:
            context.rename(store.makeQualified(draft), store.makeQualified(where), options)
        except Exception as problem:
            store.delete(draft, False)
            if store.exists(where):
                return False
            raise problem
        return True


def text_files(spark: SparkSession) -> _TextFiles:
    return _TextFiles(spark)
