"""Exact dedup over a sharded cuckoo-filter index of live digests.

The index is a table of shards. A shard has a cuckoo filter (one ``filter`` row: 16-bit
fingerprints in buckets of four) and its stored keys (``key`` rows: digest, the row that stays, number
of live copies), each under the bucket that its digest names first. A filter miss proves a digest new; a
hit is verified against the stored keys. A filter that overflows doubles and is filled again from the
stored keys. Rows of one digest are combined before they are shuffled, so a digest that a third of all
rows share is one row in its shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.session import materialise

SLOTS = 4
MAX_KICKS = 500
KEYS_PER_SHARD = 2_000

_INDEX = "shard int, kind string, bucket long, digest string, keep_id long, keep_row long, copies long, slots binary"
_FOUND = "digest string, maybe boolean, live boolean, keep_id long, keep_row long, copies long"


class CuckooFilter:
    """Fingerprints in two possible buckets each; the second follows from the first and the print."""

    def __init__(self, buckets: int = 64, slots: bytes | None = None) -> None:
        if slots is None:
            self.slots = np.zeros((buckets, SLOTS), dtype=np.uint16)
        else:
            self.slots = np.frombuffer(slots, dtype=np.uint16).reshape(-1, SLOTS).copy()

    @property
    def buckets(self) -> int:
        return len(self.slots)

    def place(self, digest: str) -> tuple[int, int]:
        """(first bucket, fingerprint) of a hex digest; 0 marks an empty slot and is no print."""
        return int(digest[:8], 16) & (self.buckets - 1), int(digest[8:12], 16) or 1

    def other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def __contains__(self, digest: str) -> bool:
        bucket, mark = self.place(digest)
        return mark in self.slots[bucket] or mark in self.slots[self.other(bucket, mark)]

    def _put(self, bucket: int, mark: int) -> bool:
        row = self.slots[bucket]
        for at in range(SLOTS):
            if row[at] == 0:
                row[at] = mark
                return True
        return False

    def add(self, digest: str) -> bool:
        """False when no free slot was found; the filter must then be built anew, larger."""
        bucket, mark = self.place(digest)
        if self._put(bucket, mark) or self._put(bucket := self.other(bucket, mark), mark):
            return True
        for kick in range(MAX_KICKS):
            at = (mark + kick) % SLOTS
            mark, self.slots[bucket, at] = int(self.slots[bucket, at]), mark
            bucket = self.other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def remove(self, digest: str) -> None:
        """Takes out one print of a digest that was added."""
        bucket, mark = self.place(digest)
        for b in (bucket, self.other(bucket, mark)):
            for at in range(SLOTS):
                if self.slots[b, at] == mark:
                    self.slots[b, at] = 0
                    return

    @classmethod
    def of(cls, digests, buckets: int) -> CuckooFilter:
        """A filter of all digests, with as many buckets as it takes, ``buckets`` at least.

        Digests must be evenly spread, as hashes are: more equal beginnings than two buckets hold are refused.
        """
        most = max(64, 16 * buckets, 16 * len(digests))
        while buckets <= most:
            made = cls(buckets)
            if all(made.add(d) for d in digests):
                return made
            buckets *= 2
        raise ValueError("digests are not evenly spread")


def _smaller(a: tuple, b: tuple) -> tuple:
    """Of two (id, row) the one that stays: the smaller id, null last, then the smaller row."""
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    return min(a, b, key=key)


def _number(x):
    return None if x is None or pd.isna(x) else int(x)


def _load(pdf: pd.DataFrame) -> tuple[CuckooFilter | None, dict[str, list]]:
    held = pdf[pdf.kind == "filter"]
    made = CuckooFilter(slots=bytes(held.slots.iloc[0])) if len(held) else None
    stored = pdf[pdf.kind == "key"]
    columns = (stored.digest, stored.keep_id, stored.keep_row, stored.copies)
    keys = {d: [_number(i), _number(r), int(n)] for d, i, r, n in zip(*columns, strict=True)}
    return made, keys


def _update(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard after its inserts and deletes."""
    made, keys = _load(pdf)
    made = made or CuckooFilter()
    for kind in ("insert", "delete"):
        part = pdf[pdf.kind == kind].sort_values("digest")
        for digest, i, r, n in zip(part.digest, part.keep_id, part.keep_row, part.copies, strict=True):
            known = digest in made and digest in keys
            if kind == "insert" and known:
                held = keys[digest]
                held[:2] = _smaller((held[0], held[1]), (_number(i), _number(r)))
                held[2] += int(n)
            elif kind == "insert":
                keys[digest] = [_number(i), _number(r), int(n)]
                if not made.add(digest):
                    made = CuckooFilter.of(keys, made.buckets * 2)
            elif known:
                keys[digest][2] -= int(n)
                if keys[digest][2] <= 0:
                    del keys[digest]
                    made.remove(digest)
    shard = int(pdf.shard.iloc[0])
    rows = [(shard, "key", made.place(d)[0], d, *held, None) for d, held in sorted(keys.items())]
    rows.append((shard, "filter", made.buckets, None, None, None, len(keys), made.slots.tobytes()))
    names = [c.split()[0] for c in _INDEX.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    for c in ("bucket", "keep_id", "keep_row", "copies"):
        out[c] = out[c].astype("Int64")
    return out


def _lookup(pdf: pd.DataFrame) -> pd.DataFrame:
    """The filter's answer for each asked digest, and the stored key's where it says maybe."""
    made, keys = _load(pdf)
    rows = []
    for digest in pdf[pdf.kind == "ask"].digest:
        maybe = made is not None and digest in made
        held = keys.get(digest) if maybe else None
        rows.append((digest, maybe, held is not None, *(held or (None, None, None))))
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")], dtype=object)
    for c in ("keep_id", "keep_row", "copies"):
        out[c] = out[c].astype("Int64")
    return out


class CuckooIndex:
    """Live digests in ``shards`` cuckoo filters with their stored keys.

    ``table`` has the columns of the module's index rows. Every change writes a new table under the
    shared folder, so a lost executor costs a task and no state.
    """

    def __init__(self, spark, shards: int, table: DataFrame | None = None) -> None:
        self.spark, self.shards = spark, shards
        self.table = table if table is not None else spark.createDataFrame([], _INDEX)

    def _rows(self, digests: DataFrame, kind: str) -> DataFrame:
        shard = F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int")
        columns = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in _INDEX.split(", ")}
        columns |= {"shard": shard, "kind": F.lit(kind), "digest": F.col("digest")}
        columns |= {c: F.col(c) for c in ("keep_id", "keep_row", "copies") if c in digests.columns}
        return digests.select(*[c.alias(name) for name, c in columns.items()])

    def _apply(self, rows: DataFrame) -> CuckooIndex:
        changed = self.table.unionByName(rows).groupBy("shard").applyInPandas(_update, _INDEX)
        return CuckooIndex(self.spark, self.shards, materialise(changed, "cuckoo"))

    def insert(self, rows: DataFrame) -> CuckooIndex:
        """Adds rows of (digest, id, row): new digests become keys, known ones gain copies.

        Null digests are not added.
        """
        return self._apply(self._rows(_combined(rows), "insert"))

    def delete(self, rows: DataFrame) -> CuckooIndex:
        """Takes out as many copies as rows of (digest, id, row) name; unknown digests change nothing.

        A digest without copies left leaves filter and keys. While copies are left, the id that
        stays is the one noted at insertion.
        """
        return self._apply(self._rows(_combined(rows), "delete"))

    def lookup(self, digests: DataFrame) -> DataFrame:
        """One row per distinct digest: ``maybe`` (the filter), ``live`` (verified) and its key."""
        asked = digests.select("digest").where("digest is not null").distinct()
        rows = self.table.unionByName(self._rows(asked, "ask"))
        return rows.groupBy("shard").applyInPandas(_lookup, _FOUND)

    def keys(self) -> DataFrame:
        """Stored keys: digest, keep_id, keep_row, copies."""
        return self.table.where("kind = 'key'").select("digest", "keep_id", "keep_row", "copies")


def _combined(rows: DataFrame) -> DataFrame:
    """One row per digest: copies, and the (id, row) that stays. Combines before the shuffle."""
    first = F.min(F.struct(F.isnull("id").alias("n"), F.col("id"), F.col("row"))).alias("f")
    found = rows.where("digest is not null").groupBy("digest").agg(first, F.count("*").alias("copies"))
    return found.select("digest", "copies", F.col("f.id").alias("keep_id"), F.col("f.row").alias("keep_row"))


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_duplicates(docs: DataFrame, keys_per_shard: int = KEYS_PER_SHARD, row: str | None = None) -> DataFrame:
    """Groups of equal normalised texts over (doc_id, text); one row per input row.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. Null texts count as empty. Of a group the
    smallest doc_id stays, null ids last. Repeated rows of one id are rows of their own: of rows
    that tie for staying, one stays. An empty table gives an empty table. Texts may have any length. Other
    columns are not looked at, whatever their names. ``row`` names a unique number of
    each row, which is then a column of the result too.
    """
    spark = docs.sparkSession
    digest = F.sha2(normalised(F.col("text")).cast("binary"), 256)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("id"),
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
        digest.alias("digest"),
    )
    rows = materialise(rows, "digests")
    shards = max(1, math.ceil(rows.count() / keys_per_shard))
    index = CuckooIndex(spark, shards).insert(rows)
    found = rows.join(index.keys(), "digest")
    return found.select(
        *([F.col("row").alias(row)] if row else []),
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("copies").alias("group_size"),
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
