"""Near-duplicate groups by one-permutation hashing with optimal densification.

Each text's set of word shingles is hashed once; the hash range is cut into equal bins and a bin's
least hash is one row of the signature. An empty bin takes the value of the bin that its own fixed
sequence of draws finds first. Bands of rows name buckets, and a bucket gives a star: edges from its least
member to the others, so that m members give m - 1 candidates.

Star edges are confirmed on full sets. That may leave two members of a bucket apart which are similar to
each other but not to the centre. So the star edges, confirmed or not, are also joined to candidate
groups; a group that the confirmed links do not make one is compared block by block on its full sets,
leaving out pairs that one centre links already. No candidate is capped or sampled.

Words are compared by 64-bit hashes of shingles, so two unequal shingles are taken for one with odds of
about one in 10^13 for a pair of long texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import FEATURE_BYTES, U64, hash_words, mix, small_batches, split_words
from convoframe.llm.components import connected_components
from convoframe.session import materialise

# Odds that a pair at the threshold shares no bucket.
MISS = 1e-7
# Nodes whose ids may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_NODES = 1_000_000
BLOCK = 64


def bands_for(threshold: float, rows: int, miss: float = MISS) -> int:
    """Bands of ``rows`` rows so that a pair at the threshold is missed with odds ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def shingle_hashes(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within it: (row offsets, hashes).

    A text of fewer words than ``size``, but not none, is one shingle.
    """
    offsets, codes, words = split_words(texts)
    lengths = np.diff(offsets)
    h = hash_words(words)[codes]
    n = len(h)
    out_len = np.where(lengths >= size, lengths - size + 1, np.minimum(lengths, 1))
    rows = np.repeat(np.arange(len(lengths)), out_len)
    first = np.concatenate([[0], np.cumsum(out_len)])
    start = np.arange(first[-1]) - np.repeat(first[:-1], out_len) + np.repeat(offsets[:-1], out_len)
    width = np.repeat(np.minimum(lengths, size), out_len)
    combined = np.zeros(len(start), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(size):
            inside = at < width
            part = h[np.minimum(start + at, max(n - 1, 0))] if n else combined
            combined = np.where(inside, mix(combined * U64(0x9E3779B97F4A7C15) + part + U64(at + 1)), combined)
    order = np.lexsort((combined, rows))
    rows, combined = rows[order], combined[order]
    fresh = np.ones(len(rows), dtype=bool)
    fresh[1:] = (rows[1:] != rows[:-1]) | (combined[1:] != combined[:-1])
    rows, combined = rows[fresh], combined[fresh]
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(lengths)))]), combined


def _draws(bins: int, attempt: int) -> np.ndarray:
    """The bin that each bin looks at in this attempt."""
    with np.errstate(over="ignore"):
        seed = np.arange(bins, dtype=np.uint64) * U64(0xD6E8FEB86659FD93) + U64(attempt + 1) * U64(0xA0761D6478BD642F)
    return (mix(seed) % U64(bins)).astype(np.int64)


def signatures(offsets: np.ndarray, hashes: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` values for each set; a set without members gives zeros."""
    n = len(offsets) - 1
    rows = np.repeat(np.arange(n), np.diff(offsets))
    # The upper half of a mixed hash picks the bin, the whole of it is the value.
    mixed = mix(hashes)
    bin_of = ((mixed >> U64(32)) * U64(bins) >> U64(32)).astype(np.int64)
    most = np.iinfo(np.uint64).max
    out = np.full(n * bins, most, dtype=np.uint64)
    np.minimum.at(out, rows * bins + bin_of, mixed)
    out = out.reshape(n, bins)
    filled = out != most
    some = filled.any(axis=1)
    out[~some] = 0
    open_row, open_bin = np.nonzero(~filled & some[:, None])
    attempt = 0
    while len(open_row):
        donor = _draws(bins, attempt)[open_bin]
        got = filled[open_row, donor]
        out[open_row[got], open_bin[got]] = out[open_row[got], donor[got]]
        open_row, open_bin = open_row[~got], open_bin[~got]
        attempt += 1
    return out


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` rows."""
    n, bins = sig.shape
    parts = sig.reshape(n, bins // rows, rows)
    key = np.broadcast_to(np.arange(bins // rows, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for at in range(rows):
            key = mix(key * U64(0x9E3779B97F4A7C15) + parts[:, :, at])
    return key


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))


def _sign(size: int, bands: int, rows: int):
    """Per text: set size, 128-bit hash of the set, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches([whole], "text", FEATURE_BYTES):
                offsets, hashes = shingle_hashes(batch.column(1), size)
                keys = band_keys(signatures(offsets, hashes, bands * rows), rows)
                ends = np.concatenate([[U64(0)], np.cumsum(hashes, dtype=np.uint64)])
                again = np.concatenate([[U64(0)], np.cumsum(mix(hashes ^ U64(0x5851F42D4C957F2D)), dtype=np.uint64)])
                sums = [x[offsets[1:]] - x[offsets[:-1]] for x in (ends, again)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.diff(offsets)),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        _lists(keys.ravel(), np.arange(len(keys) + 1) * bands),
                    ],
                    names=["row", "n", "s1", "s2", "keys"],
                )

    return run


def _sets(size: int):
    """Per text: its shingle hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches([whole], "text", FEATURE_BYTES):
                offsets, hashes = shingle_hashes(batch.column(1), size)
                columns = [batch.column(0), _lists(hashes, offsets)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "members"])

    return run


def _compare(percent: int):
    """Links between the nodes of a block, or between two blocks, that no common label joins yet.

    Only a forest of the links is given out: enough for components.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        nodes, labels, sides = pdf.node.to_numpy(), pdf.label.to_numpy(), pdf.side.to_numpy()
        sets = [np.asarray(m) for m in pdf.members]
        sizes = np.array([len(m) for m in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        values, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = counts > 1
        column = np.cumsum(shared) - 1
        kept = shared[code]
        common = np.zeros((len(sets), len(sets)), dtype=np.float32)
        width = int(shared.sum())
        at, who = column[code[kept]], owner[kept]
        # Slices of the vocabulary keep the table of members small however long the texts are.
        order = np.argsort(at, kind="stable")
        at, who = at[order], who[order]
        for start in range(0, width, 65_536):
            low, high = np.searchsorted(at, [start, start + 65_536])
            dense = np.zeros((len(sets), min(65_536, width - start)), dtype=np.float32)
            dense[who[low:high], at[low:high] - start] = 1
            common += dense @ dense.T
        union = sizes[:, None] + sizes[None, :] - common
        near = 100 * common >= percent * union
        near &= labels[:, None] != labels[None, :]
        if len(set(sides.tolist())) > 1:
            near &= sides[:, None] != sides[None, :]
        parent = list(range(len(nodes)))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        links = []
        for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            ra, rb = root(int(a)), root(int(b))
            if ra != rb:
                parent[rb] = ra
                links.append((nodes[a], nodes[b]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def _block_pairs(members: DataFrame, block: int) -> DataFrame:
    """Every node once for each pair of blocks of its group that it belongs to."""
    sizes = members.groupBy("group").agg(F.ceil(F.count("*") / F.lit(block)).alias("blocks"))
    placed = members.join(sizes, "group").withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("long")
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    paired = placed.select("*", other.alias("other"))
    return paired.select(
        "group",
        "node",
        "label",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    rows: int = 7,
    broadcast_nodes: int = BROADCAST_NODES,
    block: int = BLOCK,
    row: str | None = None,
) -> DataFrame:
    """Components of texts whose shingle sets have 100 * intersection >= ``percent`` * union.

    Input (doc_id, text); one row for each input row: doc_id, n_shingles, component_id (least doc_id
    reachable, null ids last), kept. A-Z are read as a-z and words are what ASCII white space
    separates. Null, empty and blank texts have no shingles and link with nothing. Repeated rows of one
    id are rows of their own; of rows that tie for staying, one stays. An empty table gives an
    empty table. Texts may have any length: a batch holds 1 MB of them, or one. Other columns are not looked at,
    whatever their names. ``row`` names a unique number of each row of a written table; it is then a column of the
    result too. Without it rows are numbered and written first, as they are read more than once.
    """
    bands = bands_for(percent / 100, rows)
    number = F.col(row) if row else F.monotonically_increasing_id()
    source = docs.select(number.alias("row"), F.col("text"), F.col("doc_id").cast("long").alias("id"))
    if row is None:
        source = materialise(source, "numbered")
    ids = source.select("row", "id")
    signed = source.select("row", "text").mapInArrow(
        _sign(shingle, bands, rows), "row long, n long, s1 long, s2 long, keys array<long>"
    )
    signed = materialise(signed, "signatures")

    # Equal sets are one node, named by its least row.
    filled = signed.where("n > 0")
    same = filled.groupBy("s1", "s2", "n").agg(F.min("row").alias("node"))
    nodes = filled.select(F.col("row").alias("node"), "n", "keys").join(same.select("node"), "node", "left_semi")
    buckets = nodes.select("node", "n", F.explode("keys").alias("key"))
    centres = buckets.groupBy("key").agg(
        F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("members")
    )
    stars = (
        buckets.join(centres.where("members > 1"), "key")
        .where("node <> c.node")
        .select(F.col("c.node").alias("u"), F.col("node").alias("v"), F.col("c.n").alias("nu"), F.col("n").alias("nv"))
        .distinct()
    )
    stars = materialise(stars, "stars")

    # Sets of the nodes that are in a candidate, from their texts.
    wanted = stars.select(F.explode(F.array("u", "v")).alias("row")).distinct()
    if wanted.count() <= broadcast_nodes:
        wanted = F.broadcast(wanted)
    texts = source.select("row", "text").join(wanted, "row", "left_semi")
    sets = materialise(texts.mapInArrow(_sets(shingle), "node long, members array<long>"), "sets")

    left, right = (sets.select(F.col("node").alias(x), F.col("members").alias(f"{x}s")) for x in ("u", "v"))
    possible = stars.where(100 * F.least("nu", "nv") >= percent * F.greatest("nu", "nv")).select("u", "v")
    common = F.size(F.array_intersect("us", "vs"))
    linked = (
        possible.join(right, "v")
        .join(left, "u")
        .where(100 * common >= percent * (F.size("us") + F.size("vs") - common))
        .select("u", "v")
    )
    linked = materialise(linked, "links")

    # Candidate groups that the links leave in parts are compared whole.
    candidates = connected_components(stars.select("u", "v"))
    united = connected_components(linked)
    state = candidates.join(united.withColumnRenamed("component", "part"), "node", "left").select(
        "node", F.col("component").alias("group"), F.coalesce("part", "node").alias("label")
    )
    state = materialise(state, "state")
    whole = state.groupBy("group").agg(F.min("label").alias("a"), F.max("label").alias("b"))
    apart = state.join(whole.where("a < b").select("group"), "group", "left_semi")
    pairs = _block_pairs(apart, block).join(sets, "node")
    more = pairs.groupBy("group", "i", "j").applyInPandas(_compare(percent), "u long, v long")

    # Links of equal sets complete the graph over rows.
    equal = filled.join(same, ["s1", "s2", "n"]).select(F.col("row"), "node")
    merged = united.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more)
    named = connected_components(merged)
    groups = equal.join(named, "node", "left").select("row", F.coalesce("component", "node").alias("group"))
    placed = signed.select("row", "n").join(ids, "row").join(groups, "row", "left")
    placed = placed.select("row", "id", "n", F.coalesce("group", "row").alias("group"))
    placed = materialise(placed, "groups")
    least = placed.groupBy("group").agg(F.min(F.struct(F.isnull("id").alias("x"), "id", "row")).alias("k"))
    return placed.join(least, "group").select(
        *([F.col("row").alias(row)] if row else []),
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("k.id").alias("component_id"),
        (F.col("row") == F.col("k.row")).alias("kept"),
    )
