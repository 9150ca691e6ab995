"""A chat table of immutable files and published snapshots.

A commit writes new files, then a manifest of them, and last of all publishes a snapshot: a small file named by
the version that follows its parent's, moved into place only if no other writer has taken that version. Before
that nothing has changed for any reader; a writer that dies leaves files that no snapshot names. A writer whose
parent is no longer the newest is refused (``Conflict``) and may try again on the new parent. A reader stays on
the snapshot that it began with.

    data/<commit>/_bucket=<n>/...   rows, in files by hash of their keys
    tombs/<commit>/...              (_file, keys): rows of that file which are no longer valid
    manifests/<commit>/...          files added: bucket, rows, least and greatest first key
    snapshots/<version>.json        the commits that count

Saving and deleting find the files that hold the keys concerned, by bucket and key range from the manifest and
then by their key columns alone, and add a tombstone for each (file, key). So a read joins only files that have
tombstones, only with those of their own, and takes all other files as they are; no newest row is looked for.
Compaction rewrites files with tombstones, and files that are too small, and no others.
"""

from __future__ import annotations

import functools
import json
import operator
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoframe.operators.chats import latest
from convoframe.session import materialise, text_files

# Names that a table's rows may not have.
BUCKET, FILE = "_bucket", "_file"
MANIFEST = "file string, bucket int, rows long, least string, greatest string"
# Digits of a version in the name of its snapshot.
DIGITS = 20
_PLACE = rf"([^/]+/{BUCKET}=[^/]+/[^/]+)$"


class Conflict(RuntimeError):
    """Another writer has published the version that this commit was made for."""


class ChatTable:
    """Chat documents (or message rows) by ``keys``, the newest save of a key replacing all of its rows.

    ``schema`` is that of the rows. ``buckets`` is set by the first commit: about one for each GB expected.
    """

    def __init__(self, spark: SparkSession, path: str, schema, keys: tuple[str, ...] = ("chat_id",), buckets: int = 16):
        self.spark = spark
        self.path = path.rstrip("/")
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
        self.keys = list(keys)
        self.buckets = buckets
        self.files = text_files(spark)
        if {BUCKET, FILE} & set(self.schema.names):
            raise ValueError(f"{BUCKET} and {FILE} are columns of the table's own")

    # Snapshots

    def _snapshot_path(self, version: int) -> str:
        return f"{self.path}/snapshots/{version:0{DIGITS}d}.json"

    def version(self) -> int:
        """The newest published version; 0 before the first commit."""
        names = [n for n in self.files.names(f"{self.path}/snapshots") if n.endswith(".json") and n[:DIGITS].isdigit()]
        return max((int(n[:DIGITS]) for n in names), default=0)

    def snapshot(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "manifests": [], "tombs": [], "runs": {}, "buckets": self.buckets}
        return json.loads(self.files.read(self._snapshot_path(version)))

    def history(self) -> list[dict]:
        """Version, parent, operation and time of every snapshot."""
        kept = ("version", "parent", "operation", "saved_at")
        return [{k: s[k] for k in kept} for s in map(self.snapshot, range(1, self.version() + 1))]

    def _publish(self, parent: dict, operation: str, **changes) -> int:
        version = parent["version"] + 1
        made = parent | changes | {
            "version": version,
            "parent": parent["version"],
            "operation": operation,
            "saved_at": time.time_ns() // 1_000,
        }
        if not self.files.write_new(self._snapshot_path(version), json.dumps(made)):
            raise Conflict(f"version {version} of {self.path} was published by another writer")
        return version

    # Files

    def manifest(self, snapshot: dict) -> DataFrame:
        """The live files of a snapshot: file, bucket, rows, least, greatest."""
        if not snapshot["manifests"]:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(*[f"{self.path}/manifests/{c}" for c in snapshot["manifests"]])

    def _tombs(self, snapshot: dict) -> DataFrame:
        fields = T.StructType([T.StructField(FILE, T.StringType()), *[self.schema[k] for k in self.keys]])
        if not snapshot["tombs"]:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).parquet(*[f"{self.path}/tombs/{c}" for c in snapshot["tombs"]])

    def _rows(self, names: list[str]) -> DataFrame:
        """The rows of data files, with ``_metadata``."""
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def _placed(self, names: list[str], columns: list[str]) -> DataFrame:
        """Columns of the rows of data files, with the file of each."""
        file = F.regexp_extract(F.col("_metadata.file_path"), _PLACE, 1) if names else F.lit("")
        return self._rows(names).select(*columns, file.alias(FILE))

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _write_rows(self, df: DataFrame, buckets: int) -> DataFrame:
        """Writes a commit's data files: the manifest's rows of them. A bucket with very many rows is split again."""
        commit = uuid.uuid4().hex
        rows = df.select(*self.schema.names).withColumn(BUCKET, self._bucket(buckets))
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{commit}")
        written = T.StructType([*[self.schema[k] for k in self.keys], T.StructField(BUCKET, T.IntegerType())])
        held = self.spark.read.schema(written).parquet(f"{self.path}/data/{commit}")
        nulls = functools.reduce(operator.or_, [F.col(k).isNull() for k in self.keys])
        first = F.col(self.keys[0]).cast("string")
        files = held.groupBy(F.regexp_extract("_metadata.file_path", _PLACE, 1).alias("file"), F.col(BUCKET).alias("bucket"))
        files = files.agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(first).alias("least"),
            F.max(first).alias("greatest"),
            F.count_if(nulls).alias("nulls"),
        )
        files = materialise(files, "files")
        if not files.where("nulls > 0").isEmpty():
            raise ValueError(f"rows without {', '.join(self.keys)} cannot be saved")
        return files.drop("nulls")

    def _holding(self, snapshot: dict, keys: DataFrame) -> DataFrame:
        """(_file, keys) of the snapshot's files that hold any of these keys and have not lost them yet."""
        first = F.col(self.keys[0]).cast("string")
        ranges = keys.groupBy(self._bucket(snapshot["buckets"]).alias("bucket"))
        ranges = ranges.agg(F.min(first).alias("from"), F.max(first).alias("to"))
        near = self.manifest(snapshot).join(ranges, "bucket").where("least <= to and greatest >= from")
        names = [r["file"] for r in near.select("file").collect()]
        held = self._placed(names, self.keys).distinct().join(keys, self.keys, "left_semi")
        return held.join(self._tombs(snapshot), [FILE, *self.keys], "left_anti")

    # Commits

    def _add(self, kind: str, rows: DataFrame) -> str:
        commit = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{kind}/{commit}")
        return commit

    def save(
        self,
        df: DataFrame,
        version: tuple[str, ...] = (),
        run: str | None = None,
        batch: int = 0,
        parent: int | None = None,
    ) -> int:
        """Publishes ``df`` as the newest rows of its keys; what these keys had before is gone from this version on.

        ``version`` names columns that order several saves of a key within ``df``; without it all its rows count.
        A ``run`` is a writer that may repeat itself, as a stream does: a ``batch`` that it has published is not
        published again. ``parent`` is the version that the rows were made from, by default the newest; the save
        is refused if that is no longer so. Returns the new version.
        """
        base = self.snapshot(parent)
        if run is not None and base["runs"].get(run, -1) >= batch:
            return base["version"]
        rows = latest(df, list(version), tuple(self.keys)) if version else df
        added = self._write_rows(rows, base["buckets"])
        names = [r["file"] for r in added.select("file").collect()]
        keys = self._rows(names).select(*self.keys).distinct()
        runs = base["runs"] if run is None else base["runs"] | {run: batch}
        tombs = [*base["tombs"], self._add("tombs", self._holding(base, keys))]
        return self._publish(base, "save", runs=runs, tombs=tombs, manifests=[*base["manifests"], self._add("manifests", added)])

    def delete(self, ids: DataFrame, parent: int | None = None) -> int:
        """Publishes the table without the rows of these keys. Unknown keys change nothing (see ``missing``)."""
        base = self.snapshot(parent)
        keys = ids.select(*[F.col(k).cast(self.schema[k].dataType).alias(k) for k in self.keys]).distinct()
        return self._publish(base, "delete", tombs=[*base["tombs"], self._add("tombs", self._holding(base, keys))])

    def missing(self, ids: DataFrame, version: int | None = None) -> DataFrame:
        """Keys that the table does not have."""
        return ids.select(*self.keys).distinct().join(self.read(version), self.keys, "left_anti")

    def compact(self, small: int = 0, parent: int | None = None) -> int:
        """Rewrites the files that have tombstones, and those of fewer than ``small`` rows, and drops the tombstones.

        All other files stay. The result has the same rows as its parent.
        """
        base = self.snapshot(parent)
        files = self.manifest(base)
        touched = self._tombs(base).select(F.col(FILE).alias("file")).distinct()
        worn = files.join(touched, "file", "left_semi").select("file")
        worn = worn.unionByName(files.where(F.col("rows") < small).select("file")).distinct()
        worn = materialise(worn, "worn-files")
        names = [r["file"] for r in worn.collect()]
        if not names:
            return base["version"]
        added = self._write_rows(self._live(base, names), base["buckets"])
        kept = files.join(worn, "file", "left_anti").select(*added.columns)
        return self._publish(base, "compact", tombs=[], manifests=[self._add("manifests", added.unionByName(kept))])

    # Reading

    def _live(self, snapshot: dict, names: list[str]) -> DataFrame:
        """The valid rows of files with tombstones."""
        rows = self._placed(names, self.schema.names)
        return rows.join(self._tombs(snapshot), [FILE, *self.keys], "left_anti").select(*self.schema.names)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        snapshot = self.snapshot(version)
        files = self.manifest(snapshot)
        touched = self._tombs(snapshot).select(F.col(FILE).alias("file"), F.lit(True).alias("touched")).distinct()
        listed = files.select("file").join(touched, "file", "left").collect()
        clean = [r["file"] for r in listed if not r["touched"]]
        worn = [r["file"] for r in listed if r["touched"]]
        if not worn:
            return self._rows(clean)
        live = self._live(snapshot, worn)
        return self._rows(clean).unionByName(live) if clean else live
