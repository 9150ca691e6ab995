"""How the sources of a language differ in their words: exact divergences from cells of counts.

Terms are the runs of letters (A-Z lowered, every character beyond ASCII is a letter). A language keeps the
terms that at least ``min_docs`` of its documents hold. In a group (a source of a language, or the whole
language) with N kept words, a term that occurs n times has the share p = 1 + floor(10^9 (n + 1) / (N + V)),
V being the number of kept terms. What p adds against q is f = floor((p - q)^2 / q). All of it is in whole
numbers.

Terms with equal counts have equal values, so work goes by cells of counts, not by terms:

* the words that mark a source against its language: cells (count in the source, count in the language) are
  valued once each, cells of one value are merged, values are ranked by the number of terms down to them,
  and only the cells that reach the limit are expanded to terms again, in the order of their UTF-8 bytes;
* the distance of two sources: terms with the same counts in all sources are one cell with a weight. Tasks
  add up f over the cells in tiles of ``BLOCK`` x ``BLOCK`` sources. Only counts over 0 are visited: the cells
  that two sources both lack add as many times f(0, 0) as they are.

Words are counted in tasks; their sums, and everything that grows with the vocabulary, stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoframe.llm.common import small_batches, split_words, text_of
from convoframe.session import materialise

UNIT = 1_000_000_000
# Sources on each side of a tile: it holds 8 * 256 * 256 bytes of sums in each direction.
BLOCK = 256
# Cells that a tile's sums are brought up to date with at once, and kept terms for each part of a tile's work.
CELLS = 4_096
TERMS_IN_PART = 65_536
# A table is broadcast only if it has at most so many rows and bytes of text.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 8_000_000

COUNTS = "lang string, source string, term string, n long, docs long"
SUMS = "lang string, source string, item string, value long"

# Each byte's letter: A-Z lowered, a-z and bytes beyond ASCII as they are, all else a blank.
_LETTER = np.full(256, 0x20, dtype=np.uint8)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def only_letters(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lowered and every other ASCII character but a-z blanked."""
    whole = pa.concat_arrays([texts.cast(pa.large_string())])
    offsets, data = whole.buffers()[1:]
    if data is None:
        return whole
    return pa.LargeStringArray.from_buffers(len(whole), offsets, pa.py_buffer(_LETTER[np.frombuffer(data, np.uint8)]))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch its (lang, source, term, occurrences, documents), and a null term for each group."""
    for whole in batches:
        for batch in small_batches([whole], "text", 2_000_000):
            langs = batch.column(0).dictionary_encode()
            sources = batch.column(1).dictionary_encode()
            place = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
            offsets, codes, words = split_words(only_letters(batch.column(2)), lower=False)
            width = max(1, len(words))
            row = np.repeat(np.arange(len(place)), np.diff(offsets))
            held, times = np.unique(row * width + codes, return_counts=True)
            keys, at = np.unique(place[held // width] * width + held % width, return_inverse=True)
            n = np.bincount(at, weights=times, minlength=len(keys)).astype(np.int64)
            docs = np.bincount(at, minlength=len(keys))
            groups = np.unique(place)
            place = np.concatenate([keys // width, groups])
            terms = pa.concat_arrays([words.take(pa.array(keys % width)).cast(pa.string()), pa.nulls(len(groups), pa.string())])
            yield pa.RecordBatch.from_arrays(
                [
                    langs.dictionary.take(pa.array(place // len(sources.dictionary))),
                    sources.dictionary.take(pa.array(place % len(sources.dictionary))),
                    terms,
                    pa.array(np.concatenate([n, np.zeros(len(groups), np.int64)])),
                    pa.array(np.concatenate([docs, np.zeros(len(groups), np.int64)])),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def _if_small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its measured size allows it."""
    text = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    size = sum(text, F.lit(0)).cast("long")
    rows, held = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES else df


def _share(n: str, total: str) -> Column:
    return F.expr(f"1 + (cast({n} + 1 as decimal(20, 0)) * {UNIT}) div ({total})")


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / total) by long division in steps of 1,000, exact for totals to 9 * 10^15."""
    left, out = n + 1, np.zeros_like(n)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return 1 + out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


class Tile:
    """Sums of f over cells, for the sources of two blocks against each other."""

    def __init__(self, terms: int, left: np.ndarray, right: np.ndarray):
        self.totals = [np.maximum(1, side + terms) for side in (left, right)]
        self.zero = [shares(np.zeros_like(side), total) for side, total in zip((left, right), self.totals, strict=True)]
        self.sums = [np.zeros((len(left), len(right)), np.int64), np.zeros((len(right), len(left)), np.int64)]

    def base(self, terms: int) -> None:
        """Adds what all terms would give if no source had any."""
        for k in (0, 1):
            self.sums[k] += terms * divergence(self.zero[k][:, None], self.zero[1 - k][None, :])

    def add(self, weights: np.ndarray, counts: list[np.ndarray], both: bool) -> None:
        """Cells with their counts in the left and the right sources; ``both``: in both directions."""
        parts = [
            np.where(c > 0, shares(c, t[None, :]), z[None, :])
            for c, t, z in zip(counts, self.totals, self.zero, strict=True)
        ]
        for k in range(1 + both):
            (p, q), (c, d) = (parts[k], parts[1 - k]), (counts[k], counts[1 - k])
            empty = divergence(self.zero[k][:, None], self.zero[1 - k][None, :])
            for a in range(c.shape[1]):
                rows = np.flatnonzero(c[:, a])
                if len(rows):
                    more = divergence(p[rows, a][:, None], q[rows]) - empty[a][None, :]
                    self.sums[k][a] += weights[rows] @ more
            for b in range(d.shape[1]):
                rows = np.flatnonzero(d[:, b])
                if len(rows):
                    more = divergence(self.zero[k][None, :], q[rows, b][:, None]) - empty[:, b][None, :]
                    self.sums[k][:, b] += weights[rows] @ (more * (c[rows] == 0))


def _dense(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of counts from lists of (place, n)."""
    out = np.zeros((len(lists), width), np.int64)
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    flat = lists.flatten()
    out[rows, flat.field(0).to_numpy(zero_copy_only=False)] = flat.field(1).to_numpy(zero_copy_only=False)
    return out


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each (lang, tile, part): its header row comes first, then its cells."""
    head: dict | None = None
    tile: Tile | None = None

    def done() -> Iterator[pa.RecordBatch]:
        if tile is None:
            return
        names = (head["left_names"], head["right_names"])
        for k in range(1 + (head["left"] != head["right"])):
            own, other = names[k], names[1 - k]
            rows, columns = np.divmod(np.arange(tile.sums[k].size), len(other))
            keep = np.ones(len(rows), bool) if head["left"] != head["right"] else rows != columns
            rows, columns = rows[keep], columns[keep]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([head["lang"]] * len(rows), pa.string()),
                    pa.array(own, pa.string()).take(pa.array(rows)),
                    pa.array(other, pa.string()).take(pa.array(columns)),
                    pa.array(tile.sums[k][rows, columns]),
                ],
                names=["lang", "source", "item", "value"],
            )

    for batch in batches:
        kinds = batch.column("kind").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(kinds == 0).tolist()
        for start, end in zip([0, *cuts], [*cuts, len(kinds)], strict=True):
            if start < end and kinds[start] == 0:
                yield from done()
                head = batch.slice(start, 1).to_pylist()[0]
                left, right = (np.array(head[side], np.int64) for side in ("left_totals", "right_totals"))
                tile = Tile(head["terms"], left, right)
                if head["part"] == 0:
                    tile.base(head["terms"])
                start += 1
            for at in range(start, end, CELLS):
                cells = batch.slice(at, min(CELLS, end - at))
                weights = cells.column("weight").to_numpy(zero_copy_only=False)
                counts = [_dense(cells.column(f"{side}_counts"), len(head[f"{side}_totals"])) for side in ("left", "right")]
                tile.add(weights, counts, head["left"] != head["right"])
    yield from done()


def _pairs(groups: DataFrame, kept: DataFrame, block: int, parts: int) -> DataFrame:
    """(lang, source, item, value): the sum of f over kept terms, for each two sources of a language."""
    side = "struct<place: int, n: long>"
    cells = kept.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("weight"), F.max("blocks").alias("blocks"))
    own = F.array_distinct(F.transform("counts", lambda x: F.floor(x["place"] / block).cast("int")))
    cells = cells.select("lang", "counts", "weight", "blocks", F.explode(own).alias("own"), own.alias("all"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Of two blocks that both have counts here, the lesser gives the tile.
    cells = cells.where("own <= other or not array_contains(all, other)")
    cells = cells.select(
        "lang",
        F.least("own", "other").alias("left"),
        F.greatest("own", "other").alias("right"),
        F.pmod(F.xxhash64("counts"), F.lit(parts)).cast("int").alias("part"),
        F.lit(1).alias("kind"),
        "weight",
        "counts",
    )

    def within(which: str) -> Column:
        held = F.filter("counts", lambda x: F.floor(x["place"] / block) == F.col(which))
        put = F.transform(held, lambda x: F.struct((x["place"] % block).cast("int").alias("place"), x["n"].alias("n")))
        return put.cast(f"array<{side}>").alias(f"{which}_counts")

    data = cells.select("lang", "left", "right", "part", "kind", "weight", within("left"), within("right"))
    blocks = groups.groupBy("lang", F.floor(F.col("place") / block).cast("int").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "source", "total"))).alias("members"),
        F.max("terms").alias("terms"),
    )
    one = blocks.select("lang", F.col("block").alias("left"), F.col("members").alias("a"), "terms")
    two = blocks.select("lang", F.col("block").alias("right"), F.col("members").alias("b"))
    heads = one.join(two, "lang").where(F.col("left") <= F.col("right"))
    heads = heads.select(
        "lang",
        "left",
        "right",
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
        F.lit(0).alias("kind"),
        "terms",
        F.transform("a", lambda m: m["source"]).alias("left_names"),
        F.transform("b", lambda m: m["source"]).alias("right_names"),
        F.transform("a", lambda m: m["total"]).alias("left_totals"),
        F.transform("b", lambda m: m["total"]).alias("right_totals"),
    )
    key = ["lang", "left", "right", "part"]
    dealt = heads.unionByName(data, allowMissingColumns=True).repartition(*key).sortWithinPartitions(*key, "kind")
    return dealt.mapInArrow(_tile_sums, SUMS).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _marking(groups: DataFrame, kept: DataFrame, limit: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms that mark each source against its language, to ``limit``."""
    one = kept.select("lang", "term", "lang_n", F.explode("counts").alias("c"))
    one = one.select("lang", "term", "lang_n", "c.place", "c.n")
    cells = materialise(one.groupBy("lang", "place", "n", "lang_n").agg(F.count(F.lit(1)).alias("terms_here")), "cells")
    sizes = groups.select("lang", "place", "source", "total", "lang_total", "terms")
    valued = cells.join(_if_small(sizes), ["lang", "place"])
    valued = valued.select(
        "lang",
        "place",
        "source",
        "n",
        "lang_n",
        "terms_here",
        _share("n", "total + terms").alias("p"),
        _share("lang_n", "lang_total + terms").alias("q"),
    ).where("p > q")
    valued = materialise(valued.withColumn("value", F.expr("(p - q) * (p - q) div q")), "valued")
    # Each value has a term at least, so that the first ``limit`` values always suffice.
    best = Window.partitionBy("lang", "place").orderBy(F.desc("value"))
    values = valued.groupBy("lang", "place", "value").agg(F.sum("terms_here").alias("terms_here"))
    values = values.withColumn("at", F.row_number().over(best)).where(F.col("at") <= limit)
    before = F.sum("terms_here").over(best.rowsBetween(Window.unboundedPreceding, -1))
    values = values.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < limit)
    values = materialise(values.select("lang", "place", "value"), "values")
    reached = valued.join(_if_small(values), ["lang", "place", "value"])
    reached = materialise(reached.select("lang", "place", "n", "lang_n", "source", "value"), "reached")
    found = one.join(_if_small(reached), ["lang", "place", "n", "lang_n"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    found = found.select("lang", "source", "term", "value", rank.alias("rank")).where(F.col("rank") <= limit)
    return found.select("lang", "source", F.col("term").alias("item"), "value", "rank")


def audit_sources(
    docs: DataFrame, min_docs: int = 3, limit: int = 200, block: int = BLOCK, parts: int | None = None
) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) in ``docs`` (text, lang, source).

    Part ``pair`` has each other source of the language with its distance, all ranks; part ``term`` the terms
    that are more frequent in the source than in the language, to rank ``limit``. Ranks go by value, descending,
    then by the item's UTF-8 bytes. ``block`` and ``parts`` set how the work is dealt out, not the result.

    Null text, lang and source count as empty; texts without terms still make their group. Every row is a
    document: rows that repeat an id count as often as they stand there. Ties rank by item. Texts may have any
    length; a batch holds 2 MB of them, or one text. Other columns are not looked at. Without rows the result
    is empty; a language that keeps no term has pairs of value 0 and no terms.
    """
    named = docs.select(text_of("lang").alias("lang"), text_of("source").alias("source"), text_of().alias("text"))
    found = named.mapInArrow(_count_words, COUNTS)
    counted = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = materialise(counted, "counted")
    every = counted.where("term is null").select("lang", "source")
    numbered = every.select(
        "lang",
        "source",
        (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place"),
        F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / block).cast("int").alias("blocks"),
    )
    numbered = materialise(numbered, "numbered")
    terms = counted.where("term is not null").join(_if_small(numbered), ["lang", "source"])
    kept = terms.groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"),
        F.sum("docs").alias("docs"),
        F.max("blocks").alias("blocks"),
        F.array_sort(F.collect_list(F.struct("place", "n"))).alias("counts"),
    )
    kept = materialise(kept.where(F.col("docs") >= min_docs).drop("docs"), "kept")
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.place").alias("place"))
    totals = totals.agg(F.sum("c.n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    groups = numbered.join(totals, ["lang", "place"], "left").join(langs, "lang", "left").fillna(0)
    groups = materialise(groups, "groups")

    # Each part gives a sum for each two sources, so that parts go by the vocabulary, not by the cluster's size.
    pairs = _pairs(groups, kept, block, parts or -(-kept.count() // TERMS_IN_PART) or 1)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    marks = _marking(groups, kept, limit).withColumn("part", F.lit("term"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(marks.select(columns))
