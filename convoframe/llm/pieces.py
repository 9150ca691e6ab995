"""SentencePiece encoding and decoding on a relational lattice.

A text is cut into units wherever no piece spans two neighbouring letters, so that the best path of the text
is the chain of its units' best paths. Distinct units are gathered from blocks of documents; their substrings
of bounded length are exploded and equi-joined to the piece table; the edges of a unit are grouped by their ends,
and Spark's ``aggregate`` folds the ends to the path with the largest sum of scores (of equal sums the one whose
last piece begins first). Letters without a piece cost less than any piece and become byte pieces.

Units and their hashes travel, texts do not: each block gets the paths of its own units back as files in the shared
folder, and a second scan of the documents looks them up. A block is a run of rows of one source file, known
by the file's name and the row's place in it, and so the same in every scan.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convoframe.llm.common import bound_batches, give_back, small_batches
from convoframe.session import materialise, scratch_path

SPACE = "▁"
# Rows of a file that share a dictionary of units.
BLOCK_ROWS = 8_192
# Bytes of text that a task cuts at once.
BATCH_BYTES = 2_000_000
# Longer units (no such word is in a language) are folded in Python, in time linear in their length.
LONGEST_UNIT = 64

_TAIL = ".,!?;:|#$%&*"

# Stands between units in a text of many. No piece holds it, so that it is in no other unit than itself.
BREAK = "\x00"


@dataclass
class Pieces:
    """The vocabulary: pieces that match text, and byte pieces for letters that none matches."""

    names: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]

    @classmethod
    def load(cls, file: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        ids = range(model.get_piece_size())
        names = [model.id_to_piece(i) for i in ids]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in ids]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls(names, [model.get_score(i) for i in ids], [not s for s in special], byte_ids)

    @functools.cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        rows = zip(self.names, self.scores, self.normal, strict=True)
        return {n: (i, s) for i, (n, s, ok) in enumerate(rows) if ok}

    @property
    def id_type(self) -> pa.DataType:
        """Two bytes for an id where they are enough."""
        return pa.int16() if len(self.names) < 1 << 15 else pa.int32()

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.table))

    @functools.cached_property
    def unknown(self) -> float:
        """The score of a letter that no piece matches."""
        return min(s for _, s in self.table.values()) - 10

    @functools.cached_property
    def joined(self) -> set[str]:
        """Neighbouring letters that some piece holds."""
        return {p[i : i + 2] for p in self.table for i in range(len(p) - 1)}

    def units(self, text: str) -> list[str]:
        """Parts of a text with spaces marked; no piece spans two of them."""
        joined, out, start = self.joined, [], 0
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in joined:
                out.append(text[start:i])
                start = i
        if text:
            out.append(text[start:])
        return out

    @functools.cached_property
    def tails_apart(self) -> bool:
        """Whether no piece spans a letter and one of the signs that end most chunks."""
        return not any(pair[0].isalpha() and pair[1] in _TAIL for pair in self.joined)

    def bytes_of(self, letter: str) -> list[int]:
        return [self.byte_ids[b] for b in letter.encode()]

    def best_path(self, unit: str) -> list[int]:
        """Piece ids of a unit: the fold below in plain Python."""
        best: list[tuple[float, int, int]] = [(0.0, 0, -1)]
        for end in range(1, len(unit) + 1):
            chosen = None
            for start in range(max(0, end - self.longest), end):
                found = self.table.get(unit[start:end])
                if found is None and end - start == 1:
                    found = (-1, self.unknown)
                if found and (chosen is None or best[start][0] + found[1] > chosen[0]):
                    chosen = (best[start][0] + found[1], start, found[0])
            best.append(chosen)
        out, at = [], len(unit)
        while at:
            _, start, piece = best[at]
            out.append([piece] if piece >= 0 else self.bytes_of(unit[start:at]))
            at = start
        return [i for ids in reversed(out) for i in ids]


def _cut(texts: pa.Array, pieces: Pieces) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Units of each text in order: (row offsets, code of each unit, units).

    Letters with a tail of signs, as most chunks between spaces are, are cut there, all at once; other chunks
    are cut letter by letter.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    texts = pc.replace_substring(texts, SPACE, " ")
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    chunks = coded.dictionary.cast(pa.string())
    bodies = pc.utf8_rtrim(chunks, characters=_TAIL)
    plain = pc.utf8_is_alpha(bodies).to_numpy(zero_copy_only=False) & pieces.tails_apart
    signs = plain & pc.not_equal(pc.binary_length(bodies), pc.binary_length(chunks)).to_numpy(zero_copy_only=False)
    marked = pc.binary_join_element_wise(SPACE, bodies.filter(pa.array(plain)), "").dictionary_encode()
    units = marked.dictionary

    # Units of tails and of the other chunks, as numbers after those of the marked bodies.
    others: dict[str, int] = {}

    def number(unit: str) -> int:
        return others.setdefault(unit, len(units) + len(others))

    lengths = np.ones(len(chunks), dtype=np.int64)
    parts: dict[int, list[int]] = {}
    tails: dict[str, list[int]] = {}
    tailed = np.flatnonzero(signs)
    ends = pc.utf8_length(bodies.take(pa.array(tailed))).to_pylist()
    for at, chunk, end in zip(tailed.tolist(), chunks.take(pa.array(tailed)).to_pylist(), ends, strict=True):
        own = tails.get(chunk[end:])
        if own is None:
            own = tails[chunk[end:]] = [number(u) for u in pieces.units(chunk[end:])]
        parts[at] = own
    rest = np.flatnonzero(~plain)
    empty = -1
    for at, chunk in zip(rest.tolist(), chunks.take(pa.array(rest)).to_pylist(), strict=True):
        if chunk == "":
            empty = at
        parts[at] = [number(u) for u in pieces.units(SPACE + chunk)]
    held = np.fromiter(parts, dtype=np.int64, count=len(parts))
    sizes = np.fromiter(map(len, parts.values()), dtype=np.int64, count=len(parts))
    more = np.fromiter((n for own in parts.values() for n in own), dtype=np.int64, count=int(sizes.sum()))
    lengths[held] = sizes + plain[held]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.empty(int(starts[-1]), dtype=np.int64)
    flat[starts[:-1][plain]] = marked.indices.to_numpy(zero_copy_only=False)
    flat[_ranges(starts[:-1][held] + plain[held], sizes)] = more

    unit_codes = flat[_ranges(starts[codes], lengths[codes])]
    unit_offsets = np.concatenate([[0], np.cumsum(lengths[codes])])[offsets]
    # Runs of spaces may be pieces of their own: texts with an empty chunk are cut as a whole.
    if empty >= 0:
        rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        known = {u: i for i, u in enumerate(units.to_pylist())}
        whole = np.split(unit_codes, unit_offsets[1:-1])
        for row in np.unique(rows[codes == empty]).tolist():
            text = texts[row].as_py()
            own = pieces.units(SPACE + text.replace(" ", SPACE)) if text else []
            whole[row] = np.array([known[u] if u in known else number(u) for u in own], dtype=np.int64)
        unit_offsets = np.concatenate([[0], np.cumsum([len(p) for p in whole])])
        unit_codes = np.concatenate(whole)
    return unit_offsets, unit_codes, pa.concat_arrays([units, pa.array(list(others), pa.string())])


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of consecutive ranges."""
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return np.arange(int(lengths.sum())) - np.repeat(first - starts, lengths)


def _hashes(units: pa.Array) -> np.ndarray:
    """A 64-bit hash of each unit, the same in every process."""
    if not len(units):
        return np.zeros(0, dtype=np.uint64)
    return pd.util.hash_array(units.to_numpy(zero_copy_only=False), categorize=False)


def _gather(pieces: Pieces, buckets: int):
    """(block, text) to (block, bucket, units): the distinct units of each block, as one text for each bucket."""

    def rows(block: int, seen: list[pa.Array]) -> pa.RecordBatch:
        units = pc.unique(pa.concat_arrays(seen))
        units = units.filter(pc.not_equal(units, BREAK))
        bucket = (_hashes(units) % np.uint64(buckets)).astype(np.int32)
        order = pc.sort_indices(pa.table([pa.array(bucket), units], names=["b", "u"]), [("b", "ascending"), ("u", "ascending")])
        bucket, units = bucket[order.to_numpy()], units.take(order)
        if not len(units):
            bucket, units = np.zeros(1, dtype=np.int32), pa.array([""])
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        # One text for each bucket, headed by where it is from: as one column it is shuffled once for both uses.
        lists = pa.ListArray.from_arrays(pa.array([*cuts, len(units)], pa.int32()), units)
        head = f"{block}:{TaskContext.get().partitionId()}{BREAK}"
        joined = pc.binary_join_element_wise(head, pc.binary_join(lists, BREAK), "")
        arrays = [pa.array([block] * len(cuts), pa.int64()), pa.array(bucket[cuts], pa.int32()), joined]
        return pa.RecordBatch.from_arrays(arrays, names=["block", "bucket", "units"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = None, []
        for whole in batches:
            for batch in small_batches([whole], "text", BATCH_BYTES):
                for part in _by_block(batch):
                    now = part.column(0)[0].as_py()
                    if now != block:
                        if seen:
                            yield rows(block, seen)
                        block, seen = now, []
                    units = _cut(part.column(1), pieces)[2]
                    # Kept distinct, so that a block holds its units once.
                    seen = [pc.unique(pa.concat_arrays([*seen, units]))]
        if seen:
            yield rows(block, seen)
        seen = []
        give_back()

    return run


def _by_block(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with one block each."""
    blocks = batch.column(0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
    for start, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > start:
            yield batch.slice(start, end - start)


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """(piece, id, score) of the pieces that match text: as many rows as the vocabulary file has."""
    rows = [(name, i, score) for name, (i, score) in pieces.table.items()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.float64()), strict=True)]
    return spark.createDataFrame(pa.table(columns, names=["piece", "id", "score"]))


# An edge as one number: end, start, and the piece's id from 1 on (0: a letter without one).
_START, _END = 20, 27


def _fold(ends: Column, size: Column, scores: Column) -> Column:
    """Piece ids (-1 - start for a letter without piece) of the best path over the edges of each end, by start.

    ``scores`` has a score for each id, from 1 on, and that of a letter without piece first.
    """

    def begin(edge: Column) -> Column:
        return F.shiftright(edge, _START)

    def number(edge: Column) -> Column:
        return edge.bitwiseAND((1 << _START) - 1)

    def sums(best: Column, edges: Column) -> Column:
        return F.transform(edges, lambda edge: F.get(best, begin(edge)) + F.get(scores, number(edge)))

    best = F.aggregate(
        ends, F.array(F.lit(0.0)), lambda best, edges: F.concat(best, F.array(F.array_max(sums(best, edges))))
    )
    path = F.struct(F.array().cast("array<int>").alias("edges"), best.alias("best"))

    def back(held: Column, end: Column) -> Column:
        edges, best = F.get(ends, end - 1), held["best"]
        # Of equal sums the first, which begins first.
        place = F.array_position(sums(best, edges), F.get(best, end)).cast("int") - 1
        took = F.concat(F.array(F.get(edges, place)), held["edges"])
        at = F.coalesce(begin(F.get(held["edges"], 0)), size)
        return F.when(at == end, F.struct(took.alias("edges"), best.alias("best"))).otherwise(held)

    def piece(edge: Column) -> Column:
        return F.when(number(edge) == 0, -1 - begin(edge)).otherwise(number(edge) - 1)

    steps = F.sequence(size, F.lit(1), F.lit(-1))
    return F.aggregate(steps, path, back, lambda held: F.transform(held["edges"], piece))


def best_paths(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(bucket, unit, ids) of distinct (bucket, unit) rows of at most ``LONGEST_UNIT`` letters."""
    size = F.length("unit")
    ends = units.select("bucket", "unit", F.explode(F.sequence(F.lit(1), size)).alias("e"))
    reach = F.least(F.lit(pieces.longest), F.col("e"))
    spans = ends.select("bucket", "unit", "e", F.explode(F.sequence(reach, F.lit(1), F.lit(-1))).alias("n"))
    spans = spans.withColumn("s", F.col("e") - F.col("n"))
    spans = spans.withColumn("piece", F.substring("unit", F.col("s") + 1, F.col("n")))
    # The piece table has as many rows as its file, whatever the corpus.
    table = F.broadcast(piece_table(units.sparkSession, pieces))
    matched = spans.join(table, "piece", "left").where("id is not null or n = 1")
    number = F.coalesce(F.col("id") + 1, F.lit(0)).cast("long")
    edge = F.col("e").cast("long") * (1 << _END) + F.col("s").cast("long") * (1 << _START) + number
    # The edges of a unit stand together from here on, by end and start; its first one, of its first letter, carries it.
    opens = F.col("e") == 1
    edges = matched.select(
        F.when(opens, F.col("bucket")).alias("bucket"), F.when(opens, F.col("unit")).alias("unit"), edge.alias("edge")
    )
    lattice = edges.mapInArrow(_group_edges, "bucket int, unit string, ends array<array<int>>")
    # One score for each row of the vocabulary file, as a constant of the plan.
    scores = F.split(F.lit(",".join(map(repr, [pieces.unknown, *pieces.scores]))), ",").cast("array<double>")
    return lattice.select("bucket", "unit", _fold(F.col("ends"), size, scores).alias("ids"))


def _group_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Consecutive edges to one row for each unit, which has for each end its edges by start."""

    def lists(cuts: np.ndarray, values: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.append(cuts, len(values)), pa.int32()), values)

    def grouped(batch: pa.RecordBatch) -> pa.RecordBatch:
        edges = batch.column(2).to_numpy(zero_copy_only=False)
        opens = np.flatnonzero(pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False))
        first = np.diff(edges >> _END, prepend=0) != 0
        first[opens] = True
        cuts = np.flatnonzero(first)
        each = lists(cuts, pa.array((edges & ((1 << _END) - 1)).astype(np.int32)))
        columns = [batch.column(c).take(pa.array(opens)) for c in (0, 1)]
        found = lists(np.searchsorted(cuts, opens), each)
        return pa.RecordBatch.from_arrays([*columns, found], names=["bucket", "unit", "ends"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        opens = np.flatnonzero(pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False))
        if not len(opens):
            held.append(batch)
            continue
        last = int(opens[-1])
        before = pa.Table.from_batches([*held, batch.slice(0, last)]).combine_chunks()
        for part in before.to_batches():
            yield grouped(part)
        held = [batch.slice(last)]
    if held:
        for part in pa.Table.from_batches(held).combine_chunks().to_batches():
            yield grouped(part)


def _deal(pieces: Pieces):
    """The paths of a bucket's units, for each block that asked: (block, part, bucket, ids, lengths) in the
    order of the units that it sent."""

    def run(asked: pa.Table, paths: pa.Table) -> pa.Table:
        units = paths.column("unit").combine_chunks()
        lists = paths.column("ids").combine_chunks()
        flat = [lists.values.to_numpy(zero_copy_only=False)] if len(units) else []
        bounds = lists.offsets.to_numpy().astype(np.int64) if len(units) else np.zeros(1, dtype=np.int64)
        starts, lengths = bounds[:-1].copy(), np.diff(bounds)
        total = int(bounds[-1])

        def put(place: int, path: list[int]) -> None:
            nonlocal total
            flat.append(np.array(path, dtype=np.int32))
            starts[place], lengths[place] = total, len(path)
            total += len(path)

        # Letters without a piece become bytes.
        owner = np.repeat(np.arange(len(units)), lengths)
        for place in np.unique(owner[flat[0][bounds[0] :][: len(owner)] < 0]).tolist() if flat else ():
            path = flat[0][starts[place] : starts[place] + lengths[place]].tolist()
            put(place, _bytes_in(pieces, units[place].as_py(), path))
        # Units too long for the fold are not among the paths.
        wanted = pc.split_pattern(asked.column("units").combine_chunks(), BREAK)
        heads = [own[0].as_py().split(":") for own in wanted]
        wanted = [own.values.slice(1) for own in wanted]
        every = pc.unique(pa.concat_arrays(wanted))
        missing = every.filter(pc.is_null(pc.index_in(every, value_set=units))).to_pylist()
        units = pa.concat_arrays([units.cast(pa.string()), pa.array(missing, pa.string())])
        at = len(starts)
        starts, lengths = (np.concatenate([x, np.zeros(len(missing), dtype=np.int64)]) for x in (starts, lengths))
        for place, unit in enumerate(missing, at):
            put(place, pieces.best_path(unit))
        values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int32)
        out = []
        buckets = asked.column("bucket").to_pylist()
        for (block, part), bucket, own in zip(heads, buckets, wanted, strict=True):
            place = pc.index_in(own, value_set=units).to_numpy()
            ids = values[_ranges(starts[place], lengths[place])]
            out.append((int(block), int(part), bucket, ids, lengths[place]))
        columns = list(zip(*out, strict=True)) or [[], [], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pieces.id_type), pa.list_(pa.int32()))
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.table(arrays, names=["block", "part", "bucket", "ids", "lengths"])

    return run


def _bytes_in(pieces: Pieces, unit: str, path: list[int]) -> list[int]:
    out: list[int] = []
    for i in path:
        out.extend([i] if i >= 0 else pieces.bytes_of(unit[-1 - i]))
    return out


def _look_up(pieces: Pieces, asked: str, folder: str):
    """(block, key, text) to (key, ids) by the units that the block sent and the paths that it got."""

    def load(block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        def read(place: str, columns: list[str]) -> pa.Table:
            store, path = pafs.FileSystem.from_uri(place)
            return pq.read_table(f"{path}/block={block}", filesystem=store, partitioning=None, columns=columns)

        sent = {}
        for row in read(asked, ["bucket", "units"]).to_pylist():
            head, units = row["units"].split(BREAK, 1)
            sent[int(head.split(":")[1]), row["bucket"]] = units
        units, ids, lengths = [], [], []
        got = read(folder, ["part", "bucket", "ids", "lengths"]).combine_chunks()
        keys = zip(got.column("part").to_pylist(), got.column("bucket").to_pylist(), strict=True)
        for key, i, n in zip(keys, got.column("ids"), got.column("lengths"), strict=True):
            if sent[key]:
                units.append(sent[key])
                ids.append(i.values.to_numpy())
                lengths.append(n.values.to_numpy())
        every = pc.split_pattern(pa.array([BREAK.join(units)] if units else [], pa.large_string()), BREAK).values
        # The unit that stands between the others is not sent.
        path = np.array(pieces.best_path(BREAK))
        names = np.concatenate([_hashes(every), _hashes(pa.array([BREAK]))])
        ids.append(path)
        lengths = np.concatenate([*lengths, [len(path)]])
        starts = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[:-1]
        # A unit that two parts of a block sent has the same path twice.
        names, order = np.unique(names, return_index=True)
        give_back()
        return names, np.concatenate(ids), starts[order], lengths[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, names, ids, starts, lengths = None, None, None, None, None
        for whole in batches:
            for batch in small_batches([whole], "text", BATCH_BYTES):
                for part in _by_block(batch):
                    offsets, codes, units = _cut(part.column(2), pieces)
                    if not len(units):
                        flat, counts = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
                    else:
                        now = part.column(0)[0].as_py()
                        if now != block:
                            block, (names, ids, starts, lengths) = now, load(now)
                        own = _hashes(units)
                        place = np.minimum(np.searchsorted(names, own), len(names) - 1)
                        if (names[place] != own).any():
                            raise ValueError(f"block {now} lacks units; was the source changed between scans?")
                        place = place[codes]
                        flat = ids[_ranges(starts[place], lengths[place])]
                        counts = np.concatenate([[0], np.cumsum(lengths[place], dtype=np.int64)])
                    lists = pa.ListArray.from_arrays(pa.array(counts[offsets], pa.int32()), pa.array(flat).cast(pa.int32()))
                    yield pa.RecordBatch.from_arrays([part.column(1), lists], names=["key", "ids"])
        names = ids = starts = lengths = None
        give_back()

    return run


def _placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the number of each row's block; a source that is no file is written once."""
    block = F.xxhash64("_metadata.file_path", F.expr(f"_metadata.row_index div {BLOCK_ROWS}"))
    try:
        return docs.withColumn("__block", block)
    except AnalysisException:
        return materialise(docs, "documents").withColumn("__block", block)


def encode(docs: DataFrame, file: str, key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """(``key``, ids array<int>): the best path of each whole text in the pieces of a model file.

    As SentencePiece does with this vocabulary, a space is put before a text that is not empty, and
    spaces are marked; nothing else is normalised. Null and empty texts have no ids. Rows are encoded one by
    one, repeated or not; other columns are not read. An empty table gives an empty table.
    """
    return _encoded(docs, file, key, buckets, False)


def encode_and_decode(docs: DataFrame, file: str, key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """(``key``, ids, text): as ``encode``, and the text that ``decode`` gives for the ids, in one pass."""
    return _encoded(docs, file, key, buckets, True)


def _encoded(docs: DataFrame, file: str, key: str, buckets: int | None, back: bool) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    pieces = Pieces.load(file)
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(docs.dtypes)[key]
    source = _placed(docs.select(key, "text") if key != "text" else docs.select("text"))
    source = source.select(F.col("__block").alias("block"), F.col(key).alias("key"), "text")
    asked = source.select("block", "text").mapInArrow(_gather(pieces, buckets), "block long, bucket int, units string")
    sent = scratch_path(spark, "units")
    asked.write.partitionBy("block").parquet(sent)
    placed = spark.read.schema("bucket int, units string").parquet(sent).select("bucket", "units").repartition("bucket")
    units = F.split("units", BREAK)
    every = placed.select("bucket", F.explode(F.slice(units, F.lit(2), F.size(units))).alias("unit")).distinct()
    paths = best_paths(every.where(F.length("unit").between(1, LONGEST_UNIT)), pieces)
    paths = paths.select(F.col("bucket").alias("of"), "unit", "ids")
    ids = "array<smallint>" if pieces.id_type == pa.int16() else "array<int>"
    dealt = placed.groupBy("bucket").cogroup(paths.groupBy("of")).applyInArrow(
        _deal(pieces), f"block long, part int, bucket int, ids {ids}, lengths array<int>"
    )
    folder = scratch_path(spark, "paths")
    dealt.repartition("block").write.partitionBy("block").parquet(folder)
    look_up, texts_of = _look_up(pieces, sent, folder), _texts_of(pieces)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in look_up(batches):
            columns = [*batch.columns, texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "ids", "text"])

    if back:
        found = source.mapInArrow(both, f"key {kind}, ids array<int>, text string")
    else:
        found = source.mapInArrow(look_up, f"key {kind}, ids array<int>")
    return found.withColumnRenamed("key", key)


def _texts_of(pieces: Pieces):
    """The function from lists of ids to texts."""
    names = [name.replace(SPACE, " ").encode() for name in pieces.names]
    for i, (name, normal) in enumerate(zip(pieces.names, pieces.normal, strict=True)):
        if not normal:
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", name)
            names[i] = bytes([int(byte[1], 16)]) if byte else b""

    def texts_of(lists: pa.Array) -> pa.Array:
        table = pa.array(names, pa.binary())
        lists = lists.fill_null([]) if lists.null_count else lists
        texts: list[str] = []
        for row in range(0, len(lists), 512):
            own = lists.slice(row, 512)
            bounds = own.offsets.to_numpy()
            letters = table.take(own.values.slice(bounds[0], bounds[-1] - bounds[0]))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds - bounds[0], pa.int32()), letters), b"")
            found = [t.decode("utf-8", "replace") for t in joined.to_pylist()]
            # The space before the text is the encoder's own.
            texts.extend(t[1:] if t.startswith(" ") else t for t in found)
        return pa.array(texts, pa.string())

    return texts_of


def decode(encoded: DataFrame, file: str, key: str = "doc_id") -> DataFrame:
    """(``key``, text) of (``key``, ids): pieces joined, marks read as spaces, the leading space taken off.

    Control pieces give nothing; null and empty id lists give the empty text.
    """
    kind = dict(encoded.dtypes)[key]
    rows = encoded.select(F.col(key).alias("key"), "ids")
    texts_of = _texts_of(Pieces.load(file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(0, whole.num_rows, 512):
                batch = whole.slice(row, 512)
                yield pa.RecordBatch.from_arrays([batch.column(0), texts_of(batch.column(1))], names=["key", "text"])

    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
