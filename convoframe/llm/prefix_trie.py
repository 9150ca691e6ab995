"""The trie of conversation prefixes: which conversations begin alike, how deep, and what sharing them saves.

Every distinct turn (role, text) gets a dense number, so that a conversation is a list of numbers. Lists are
dealt out by ranges of (prefix, list, conversation): each task gets neighbours in that order, a shard of
prefixes, however many conversations begin alike or are copies. A task works through its shard in blocks. For a
block it packs a *double array*: a node is a slot, ``BASE[slot] + code`` is the slot that a turn leads to, and
``CHECK`` of that slot names the node it belongs to. The block's conversations are walked through it for their
nodes.

Nodes that several blocks share (the upper ones, and those of copies) come out of each of them. A node's key is
the hash of its whole prefix, two polynomials modulo 2^61 - 1, so parts of one node meet by key and their
counts are merged.

What is summed over subtrees needs no walk from level to level. A node belongs to its least member; the nodes of
a conversation that it owns are the lower end of its path. So a subtree's sum is, over its members, what they
own, but for the owner itself only what it owns from this depth on. That is one sum along each path and one sum
over members by node.

Conversations of more than ``span`` turns are cut into spans. A span starts at the node where the one before
ends, whose key is the hash of all that comes before; no task or row holds more than a span of a conversation.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoframe.operators.messages import number_turns
from convoframe.session import materialise

# Turns in a span; turns and conversations in a block; conversation ids in a chunk.
SPAN = 4_096
BLOCK_TURNS = 262_144
BLOCK_ROWS = 32_768
CHUNK = 65_536
# Free places that are tried for a node of several children before the array grows.
TRIES = 24
# Distinct turns whose numbers may be broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 50_000

PRIME = (1 << 61) - 1
FACTORS = (0x2545F491, 0x369DEA0F)

PARTS = (
    "k1 long, k2 long, p1 long, p2 long, depth long, points long, n long, owner long, members array<long>, ends array<long>"
)
KEYS = ["k1", "k2", "depth"]


def follow(key: np.ndarray, factor: int, turn: np.ndarray) -> np.ndarray:
    """key * factor + turn + 1 modulo 2^61 - 1, for keys below it and factors below 2^30."""
    high, low = key >> 31, key & ((1 << 31) - 1)
    # high * factor * 2^31, where 2^61 counts as 1.
    top = high * factor
    out = (top >> 30) + ((top & ((1 << 30) - 1)) << 31) + low * factor
    return (out % PRIME + turn + 1) % PRIME


class DoubleArray:
    """BASE and CHECK over codes from 1; slots 0 to ``roots`` - 1 are roots."""

    FREE = -1
    ROOT = -2

    def __init__(self, roots: int, codes: int):
        self.base = np.zeros(roots + codes + 1, np.int64)
        self.check = np.full(roots + codes + 1, self.FREE, np.int64)
        self.check[:roots] = self.ROOT

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, len(self.check) * 65 // 64) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, self.FREE, np.int64)])

    def insert(self, parents: np.ndarray, codes: np.ndarray) -> None:
        """Gives each parent slot, which has no children yet, all of its children; a parent's rows lie together."""
        if not len(parents):
            return
        starts = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.append(starts, len(parents)))
        free, at = np.flatnonzero(self.check == self.FREE), 0
        for k in np.flatnonzero(sizes > 1).tolist():
            own = np.sort(codes[starts[k] : starts[k] + sizes[k]])
            span = int(own[-1] - own[0]) + 1
            # Places whose last child still lies in the array, from all over it: neighbours are full alike.
            fits = int(np.searchsorted(free, len(self.check) - span, side="right"))
            tried = free[(at + np.arange(TRIES) * (fits // TRIES + 1)) % fits] if fits else free[:0]
            for place in tried.tolist():
                slots = place - own[0] + own
                if (self.check[slots] == self.FREE).all():
                    break
            else:
                end = len(self.check)
                self._grow(end + span)
                free, at = np.flatnonzero(self.check == self.FREE), 0
                slots = end - own[0] + own
            at += 1
            self.base[parents[starts[k]]] = slots[0] - own[0]
            self.check[slots] = parents[starts[k]]
        # A node of one child fits into any free slot.
        one = starts[sizes == 1]
        free = np.flatnonzero(self.check == self.FREE)
        if len(free) < len(one):
            end = len(self.check)
            self._grow(end + len(one) - len(free))
            free = np.flatnonzero(self.check == self.FREE)
        slots = free[: len(one)]
        self.base[parents[one]] = slots - codes[one]
        self.check[slots] = parents[one]

    def step(self, slots: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The slots that the codes lead to; -1 where there is no such child."""
        to = self.base[slots] + codes
        inside = (to >= 0) & (to < len(self.check))
        there = inside & (self.check[np.where(inside, to, 0)] == slots)
        return np.where(there, to, -1)


def _block(rows: dict[str, np.ndarray], span: int) -> Iterator[pa.RecordBatch]:
    """The parts of all nodes of a block; its rows are in order of (prefix, list, conversation)."""
    conv, lengths, total = rows["conv"], rows["lengths"], rows["total"]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # Codes in the order of first use: turns of one subtree have near codes, and nodes need narrow places.
    alphabet, seen, codes = np.unique(rows["ids"], return_index=True, return_inverse=True)
    order = np.empty(len(alphabet), np.int64)
    order[np.argsort(seen)] = np.arange(1, len(alphabet) + 1)
    codes = order[codes]
    keys = [rows["k1"], rows["k2"]]
    change = np.concatenate([[True], (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])])
    slots = np.cumsum(change) - 1
    trie = DoubleArray(int(slots[-1]) + 1, len(alphabet))

    def parts(at: np.ndarray, slot: np.ndarray, parent: list[np.ndarray], depth: np.ndarray, points: np.ndarray) -> pa.RecordBatch:
        """One part for each run of equal slots among the rows ``at``."""
        first = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
        size = np.diff(np.append(first, len(at)))
        ends = total[at] == depth
        ended = np.concatenate([[0], np.cumsum(np.add.reduceat(ends.astype(np.int64), first))])
        missing = depth[first] == 0
        return pa.RecordBatch.from_arrays(
            [
                *[pa.array(k[at][first]) for k in keys],
                *[pa.array(p[first], mask=missing) for p in parent],
                pa.array(depth[first]),
                pa.array(points[first]),
                pa.array(size),
                pa.array(np.minimum.reduceat(conv[at], first)),
                pa.ListArray.from_arrays(pa.array(np.append(first, len(at)), pa.int32()), pa.array(conv[at])),
                pa.ListArray.from_arrays(pa.array(ended, pa.int32()), pa.array(conv[at][ends])),
            ],
            names=[column.split()[0] for column in PARTS.split(", ")],
        )

    top = np.flatnonzero(rows["seg"] == 0)
    if len(top):
        none = np.zeros(len(top), np.int64)
        yield parts(top, slots[top], [none, none], none, none)
    for d in range(int(lengths.max())):
        at = np.flatnonzero(lengths > d)
        code = codes[starts[at] + d]
        fresh = np.flatnonzero(
            np.concatenate([[True], (slots[at][1:] != slots[at][:-1]) | (code[1:] != code[:-1])])
        )
        trie.insert(slots[at][fresh], code[fresh])
        slots[at] = trie.step(slots[at], code)
        before = [k[at] for k in keys]
        turn = rows["ids"][starts[at] + d]
        for k, factor in zip(keys, FACTORS, strict=True):
            k[at] = follow(k[at], factor, turn)
        yield parts(at, slots[at], before, rows["seg"][at] * span + d + 1, rows["points"][starts[at] + d])


def _packer(span: int, turns: int, most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def block() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            one = {c: whole.column(c).to_numpy().copy() for c in ("conv", "seg", "k1", "k2", "total")}
            for name in ("ids", "points"):
                lists = whole.column(name).combine_chunks()
                one[name] = lists.flatten().to_numpy(zero_copy_only=False)
            one["lengths"] = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            yield from _block(one, span)

        for batch in batches:
            ends = np.cumsum(batch.column("ids").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            start = done = 0
            while start < batch.num_rows:
                # Rows that still fit; a list too long for any block makes one alone.
                fit = int(np.searchsorted(ends, done + turns - size, side="right"))
                fit = max(min(fit, start + most - rows), start + (not held))
                if fit > start:
                    held.append(batch.slice(start, fit - start))
                    size, rows = size + int(ends[fit - 1]) - done, rows + fit - start
                    start, done = fit, int(ends[fit - 1])
                if start < batch.num_rows or size >= turns or rows >= most:
                    yield from block()
                    held.clear()
                    size = rows = 0
        if held:
            yield from block()

    return work


def _span_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each span its own hash, as if nothing came before it."""
    for batch in batches:
        found: list[list[int]] = [[], []]
        for ids in batch.column("ids").to_pylist():
            for out, factor in zip(found, FACTORS, strict=True):
                key = 0
                for turn in ids:
                    key = (key * factor + turn + 1) % PRIME
                out.append(key)
        hashes = [pa.array(f, pa.int64()) for f in found]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seg"), *hashes], names=["conv", "seg", "g1", "g2"])


def _span_starts(span: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash of all that comes before each span of a conversation."""
        shift = [pow(f, span, PRIME) for f in FACTORS]
        for batch in batches:
            out: list[list[int]] = [[], [], [], []]
            for row in batch.to_pylist():
                keys = [0, 0]
                for one in row["spans"]:
                    for column, value in zip(out, (row["conv"], one["seg"], *keys), strict=True):
                        column.append(value)
                    keys = [(k * s + g) % PRIME for k, s, g in zip(keys, shift, (one["g1"], one["g2"]), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["conv", "seg", "k1", "k2"])

    return work


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each node, packed: their differences, compressed where they are many."""
    for whole in batches:
        for from_row in range(0, whole.num_rows, CHUNK):
            batch = whole.slice(from_row, CHUNK)
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*KEYS, "conv")]
            change = np.any([c[1:] != c[:-1] for c in columns[:3]], axis=0)
            first = np.flatnonzero(np.concatenate([[True], change]))
            conv, packed = columns[3], []
            sizes = np.diff(np.append(first, len(conv)))
            for start, size in zip(first.tolist(), sizes.tolist(), strict=True):
                steps = np.diff(conv[start : start + size], prepend=0).astype("<i8").tobytes()
                packed.append(zlib.compress(steps, 1) if size > 64 else steps)
            arrays = [pa.array(c[first]) for c in columns] + [pa.array(sizes), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "first", "size", "packed"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's ids, of its chunks one after the other."""
    node, digest = None, hashlib.sha256()
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for row in batch.to_pylist():
            steps = zlib.decompress(row["packed"]) if row["size"] > 64 else row["packed"]
            text = ",".join(map(str, np.cumsum(np.frombuffer(steps, "<i8")).tolist())).encode()
            own = (row["k1"], row["k2"], row["depth"])
            if own != node:
                if node is not None:
                    for column, value in zip(out, (*node, digest.hexdigest()), strict=True):
                        column.append(value)
                node, digest = own, hashlib.sha256(text)
            else:
                digest.update(b"," + text)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[*KEYS, "sha"])
    if node is not None:
        arrays = [pa.array([v], k) for v, k in zip((*node, digest.hexdigest()), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=[*KEYS, "sha"])


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, dictionary): turns as (conv, pos, id, points), positions from 0, ids dense over distinct turns.

    The dictionary has each distinct turn's id, digest and code points. Null role and text count as empty.
    """
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("chat_id"), "turn", said.alias("said")
    )
    # The role's length keeps ("ab", "c") from ("a", "bc").
    whole = F.concat(F.length("said.role").cast("string"), F.lit(":"), "said.role", "said.text")
    rows = number_turns(rows, "turn", "said").select(
        F.col("chat_id").alias("conv"),
        F.col("turn").alias("pos"),
        F.sha2(whole, 256).alias("digest"),
        F.length("said.text").cast("long").alias("points"),
    )
    rows = materialise(rows, "turns")
    distinct = rows.groupBy("digest").agg(F.max("points").alias("points")).withColumn("task", F.spark_partition_id())
    distinct = materialise(distinct, "distinct-turns")
    sizes = distinct.groupBy("task").agg(F.count(F.lit(1)).alias("held"))
    # One row for each task that wrote.
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("task", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("task").orderBy("digest")) - 1
    ids = distinct.withColumn("within", within).join(F.broadcast(sizes), "task")
    ids = materialise(ids.select("digest", (F.col("before") + F.col("within")).alias("id"), "points"), "turn-ids")
    known = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    turns = rows.drop("points").join(known, "digest").select("conv", "pos", "id", "points")
    return materialise(turns, "numbered"), ids


def borrowed_heads(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first turns from the one their hundred begins with: (turns, lengths).

    Of conversation c, the first h = crc32(c) modulo ``most`` turns are those of c - c modulo ``every`` (all
    that it has, if fewer; none if it is not there); its own follow from turn h on. Lengths has every
    conversation, also those left without a turn.
    """
    number = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    first = turns.where(F.col("pos") < most - 1).select(F.col("conv").alias("source"), "pos", "id", "points")
    given = own.select(F.col("conv").alias("source"), F.col("own").alias("there"))
    convs = own.select("conv", "own", number.alias("h"), (F.col("conv") - F.col("conv") % every).alias("source"))
    convs = convs.join(given, "source", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    total = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    convs = materialise(convs.select("conv", "source", "h", "taken", total.alias("total")), "conversations")
    heads = first.join(convs, "source").where(F.col("pos") < F.col("taken"))
    rest = turns.join(convs, "conv").where(F.col("pos") >= F.col("h"))
    rest = rest.withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    columns = ["conv", "pos", "id", "points"]
    return heads.select(columns).unionByName(rest.select(columns)), convs.select("conv", "total")


def as_they_are(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    return turns, turns.groupBy("conv").agg(F.count(F.lit(1)).alias("total"))


def _lists(turns: DataFrame, lengths: DataFrame, span: int) -> DataFrame:
    """A row for each span of a conversation: its turns in order, and the hash of all that comes before."""
    turn = F.struct("pos", "id", "points")
    rows = turns.select("conv", F.floor(F.col("pos") / span).cast("long").alias("seg"), turn.alias("t"), F.lit(None).cast("long").alias("total"))
    # A row of the length, so that a conversation without turns is there too; long ones get it in each span.
    spans = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("total") - 1) / span)).cast("long"))
    marks = lengths.select("conv", F.explode(spans).alias("seg"), F.lit(None).cast(rows.schema["t"].dataType).alias("t"), "total")
    lists = rows.unionByName(marks).groupBy("conv", "seg").agg(
        F.array_sort(F.collect_list("t")).alias("ts"), F.max("total").cast("long").alias("total")
    )
    lists = lists.select(
        "conv",
        "seg",
        "total",
        F.transform("ts", lambda t: t["id"]).alias("ids"),
        F.transform("ts", lambda t: t["points"]).alias("points"),
    )
    lists = materialise(lists, "lists")
    zero = F.lit(0).cast("long")
    short = lists.where(F.col("total") <= span).withColumns({"k1": zero, "k2": zero})
    long = lists.where(F.col("total") > span)
    hashed = long.select("conv", "seg", "ids").mapInArrow(_span_hashes, "conv long, seg long, g1 long, g2 long")
    chains = hashed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("seg", "g1", "g2"))).alias("spans"))
    begun = chains.mapInArrow(_span_starts(span), "conv long, seg long, k1 long, k2 long")
    return short.unionByName(long.join(begun, ["conv", "seg"]))


def _end_digests(parts: DataFrame) -> DataFrame:
    """A digest of the ids of the conversations that end at each node, in ascending order."""
    ends = parts.select(*KEYS, F.explode("ends").alias("conv"))
    order = [*KEYS, "conv"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = chunks.mapInArrow(_chunks, "k1 long, k2 long, depth long, first long, size long, packed binary")
    # A node's chunks go to one task one after the other; it holds a chunk at a time.
    dealt = chunks.repartition(*KEYS).sortWithinPartitions(*KEYS, "first")
    return dealt.mapInArrow(_digests, "k1 long, k2 long, depth long, sha string")


def _sum_over(column: str, window) -> Column:
    return F.sum(column).over(window)


def prefix_trie(
    conversations: DataFrame,
    rebuild: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = as_they_are,
    span: int = SPAN,
    block_turns: int = BLOCK_TURNS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """A row for each distinct prefix of ``conversations`` (conv_id, turn, role, text), the empty one included.

    conv_id is the least conversation that begins so, depth the number of turns; then parent_conv_id (null for
    the empty prefix), n_convs, n_children, n_leaves (nodes without children in its subtree, itself included),
    saved_tokens (over its subtree: the code points of a node's last text, for each conversation but one that
    shares it) and ends_sha256 (of the ids of conversations that end here, ascending, joined by commas).
    ``rebuild`` may make other conversations of the numbered turns. ``span``, ``block_turns`` and ``block_rows``
    bound what a row and a task hold; the result does not depend on them.

    Turns go by ``turn``, null first; turns of equal number go by role and text, and rows that repeat each
    other are turns of their own. Null role and text count as empty; rows without conv_id belong to no
    conversation. Texts may have any length: only their digests and lengths travel. Other columns are not
    looked at. Without rows there is no node.
    """
    turns, _ = numbered_turns(conversations)
    lists = materialise(_lists(*rebuild(turns), span), "spans")
    order = ["k1", "k2", "ids", "conv"]
    shards = lists.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialise(shards.mapInArrow(_packer(span, block_turns, block_rows), PARTS), "parts")

    nodes = parts.groupBy(*KEYS).agg(
        F.sum("n").alias("n"),
        F.min("owner").alias("owner"),
        *[F.max(c).alias(c) for c in ("p1", "p2", "points")],
    )
    nodes = materialise(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth"))
    nodes = nodes.join(children.agg(F.count(F.lit(1)).alias("n_children")), KEYS, "left").fillna(0, ["n_children"])
    nodes = nodes.select(
        *KEYS,
        "p1",
        "p2",
        "n",
        "owner",
        "n_children",
        ((F.col("n") - 1) * F.col("points")).alias("saved"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        F.floor(F.col("depth") / span).alias("seg"),
    )
    nodes = materialise(nodes, "counted-nodes")

    # What the owner has from each node down: within the span, and in the spans below.
    below = Window.partitionBy("owner", "seg").orderBy(F.desc("depth"))
    sums = {f"{c}_down": F.sum(c).over(below) for c in ("saved", "leaf")}
    spans = nodes.groupBy("owner", "seg").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    deeper = Window.partitionBy("owner").orderBy(F.desc("seg")).rowsBetween(Window.unboundedPreceding, -1)
    owned = Window.partitionBy("owner")
    spans = spans.select(
        "owner",
        "seg",
        *[F.coalesce(F.sum(c).over(deeper), F.lit(0)).alias(f"{c}_after") for c in ("saved", "leaf")],
        *[F.sum(c).over(owned).alias(f"{c}_owned") for c in ("saved", "leaf")],
    )
    spans = materialise(spans, "owned")
    down = nodes.withColumns(sums).join(spans, ["owner", "seg"])

    total = spans.groupBy("owner").agg(*[F.max(f"{c}_owned").alias(f"{c}_all") for c in ("saved", "leaf")])
    total = materialise(total.withColumnRenamed("owner", "member"), "totals")
    held = parts.select(*KEYS, F.explode("members").alias("member")).join(total, "member")
    held = held.groupBy(*KEYS).agg(F.sum("saved_all").alias("saved_all"), F.sum("leaf_all").alias("leaf_all"))

    up = nodes.select(*[F.col(c).alias(f"{c}_up") for c in (*KEYS, "owner")])
    parent = (F.col("p1") == F.col("k1_up")) & (F.col("p2") == F.col("k2_up")) & (F.col("depth") - 1 == F.col("depth_up"))
    parents = nodes.select(*KEYS, "p1", "p2").join(up, parent).select(*KEYS, F.col("owner_up").alias("parent_conv_id"))
    result = down.join(held, KEYS).join(parents, KEYS, "left").join(_end_digests(parts), KEYS, "left")
    under = lambda c: (F.col(f"{c}_all") - F.col(f"{c}_owned") + F.col(f"{c}_after") + F.col(f"{c}_down")).cast("long")
    return result.select(
        F.col("owner").alias("conv_id"),
        "depth",
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        "n_children",
        under("leaf").alias("n_leaves"),
        under("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
