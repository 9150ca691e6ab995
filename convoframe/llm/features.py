"""Hashed word and shape features of texts, and bounded samples to fit classifiers on."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import FEATURE_BYTES, U64, held_out, mix, small_batches, split_words

BITS = 20

# Letters of an inner run of a word, and letters whose runs are hashed at once.
INNER = 5
RUNS_AT_ONCE = 1 << 20

_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[^\W_]+|[\W_]+")
_SHAPES = [(re.compile(r"[^\W\d_]"), "x"), (re.compile(r"\d"), "9")]


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _shape(part: str) -> str:
    """Upper, lower, capitalised or mixed letters, digits, or up to three signs of the part."""
    if part.isdigit():
        return "<9>"
    if part.isupper() and len(part) > 1:
        return "<X>"
    if part.istitle():
        return "<Xx>"
    return "<x>" if part.isalnum() else part[:3]


def spread(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For codes that name ranges: (which code each value is from, where the value lies)."""
    lengths = (starts[1:] - starts[:-1])[codes]
    owner = np.repeat(np.arange(len(codes)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return owner, np.arange(len(owner)) - first[owner] + starts[codes][owner]


def distinct_per_row(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.unique((rows.astype(np.uint64) << U64(32)) | values.astype(np.uint64))
    return (keys >> U64(32)).astype(np.int64), (keys & U64(0xFFFFFFFF)).astype(np.int64)


def word_parts(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of each distinct chunk: (ranges, hash of the part in lower case, hash of its shape)."""
    starts, low, shape = [0], [], []
    cache: dict[str, int] = {}
    for word in words.to_pylist():
        for part in _PARTS.findall(word):
            low.append(_hash(part.lower() if part[0].isalnum() else part[:3]))
            s = _shape(part)
            if s not in cache:
                cache[s] = _hash(s)
            shape.append(cache[s])
        starts.append(len(low))
    return np.array(starts), np.array(low, dtype=np.uint64), np.array(shape, dtype=np.uint64)


def _inner_runs(letters: np.ndarray) -> np.ndarray:
    """Hash of the ``INNER`` code points from each position on that has so many after it."""
    n = max(len(letters) - INNER + 1, 0)
    out = np.empty(n, dtype=np.uint64)
    for low in range(0, n, RUNS_AT_ONCE):
        high = min(low + RUNS_AT_ONCE, n)
        # Code points take 21 bits, so that three fit in a number.
        a, b, c, d, e = (letters[low + at : high + at].astype(np.uint64) for at in range(INNER))
        with np.errstate(over="ignore"):
            half = mix((a << U64(42) | b << U64(21) | c) + U64(1)) * U64(0x9E3779B97F4A7C15)
            out[low:high] = mix(half + (d << U64(21) | e))
    return out


def word_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words of each distinct chunk with their beginnings and all their inner runs of letters, however long
    they are: (ranges, hashes). A word of ``INNER`` letters is its only run."""
    owner, found, owners, every = [], [], [], []
    for at, chunk in enumerate(words.to_pylist()):
        for word in _WORD.findall(chunk.lower()):
            grams = ["^" + word[:n] for n in range(3, min(len(word), 6) + 1)]
            if len(word) != INNER:
                grams.append(word)
            found.extend(map(_hash, grams))
            owner.extend([at] * len(grams))
            if len(word) >= INNER:
                every.append(word)
                owners.append(at)
    sizes = np.fromiter(map(len, every), dtype=np.int64, count=len(every))
    letters = np.frombuffer("".join(every).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    runs = _inner_runs(letters)
    # Runs that begin in the last letters of a word would reach into the next one.
    inside = np.ones(len(letters), dtype=bool)
    for back in range(1, INNER):
        inside[np.cumsum(sizes) - back] = False
    runs = runs[inside[: len(runs)]]
    whose = np.repeat(np.array(owners, dtype=np.int64), sizes - INNER + 1)
    whose = np.concatenate([np.array(owner, dtype=np.int64), whose])
    order = np.argsort(whose, kind="stable")
    starts = np.concatenate([[0], np.cumsum(np.bincount(whose, minlength=len(words)))])
    return starts, np.concatenate([np.array(found, dtype=np.uint64), runs])[order]


def text_features(texts: pa.Array, bits: int = BITS, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, as (row of each feature, feature id).

    With ``pairs`` these are words and signs, their shapes, and neighbouring pairs of both; else words
    with their beginnings and inner runs.
    """
    offsets, codes, words = split_words(texts, lower=False)
    if pairs:
        starts, low, shape = word_parts(words)
    else:
        starts, low = word_grams(words)
    owner, at = spread(codes, starts)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[owner]
    h = [low[at]]
    r = [rows]
    if pairs:
        beside = rows[1:] == rows[:-1]
        with np.errstate(over="ignore"):
            for x, salt in ((low[at], 1), (shape[at], 2)):
                two = mix(x[:-1] * U64(0x9E3779B97F4A7C15) + x[1:] + U64(salt))
                h.append(two[beside])
                r.append(rows[1:][beside])
            h.append(shape[at] + U64(3))
            r.append(rows)
    values = mix(np.concatenate(h)) >> U64(64 - bits)
    return distinct_per_row(np.concatenate(r), values)


def feature_lists(bits: int, pairs: bool):
    """Maps (label, text) to (label, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches([whole], "text", FEATURE_BYTES):
                rows, values = text_features(batch.column(1), bits, pairs)
                counts = np.bincount(rows, minlength=batch.num_rows)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["label", "features"])

    return run


class Rows:
    """Feature lists as one flat array with row starts."""

    def __init__(self, starts: np.ndarray, ids: np.ndarray) -> None:
        self.starts, self.ids = starts.astype(np.int64), ids
        self.owner = np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.starts))

    @classmethod
    def of(cls, lists: list[np.ndarray]) -> Rows:
        starts = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
        return cls(starts, np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32))

    def __len__(self) -> int:
        return len(self.starts) - 1

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=weights[self.ids], minlength=len(self))

    def counts(self, size: int) -> np.ndarray:
        """How many rows have each feature, a slice at a time."""
        out = np.zeros(size, dtype=np.int64)
        for at in range(0, len(self.ids), 1_000_000):
            out += np.bincount(self.ids[at : at + 1_000_000], minlength=size)
        return out

    def only(self, place: np.ndarray) -> Rows:
        """The features with a place of 0 or more, numbered by it."""
        moved = place[self.ids]
        keep = moved >= 0
        lengths = np.bincount(self.owner[keep], minlength=len(self))
        return Rows(np.concatenate([[0], np.cumsum(lengths)]), moved[keep])

    def __iter__(self):
        return (self.ids[a:b] for a, b in zip(self.starts[:-1], self.starts[1:], strict=True))


def sampled_features(
    docs: DataFrame, rows: DataFrame, limit: int, bits: int, pairs: bool
) -> tuple[np.ndarray, Rows]:
    """Labels and features of ``limit`` rows of (doc_id, label) at the most, with their texts.

    The rows with the least hashes of their ids are taken, each (doc_id, label) once, so that a sample is spread
    evenly and is the same each time. Of the rows of ``docs`` with a sampled id, the one with the least hash of its
    text counts. This bounds what is collected, however often an id is repeated: ``limit`` lists of the features of
    one text.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    chosen = rows.select("doc_id", "label").distinct().orderBy(order, "doc_id", "label").limit(limit)
    ids = chosen.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    texts = one.select("doc_id", "one.text").join(F.broadcast(chosen), "doc_id")
    # Fits depend on the order of rows; by id it is the same however the rows were shuffled.
    texts = texts.orderBy("doc_id", "label")
    made = texts.select("label", "text").mapInArrow(feature_lists(bits, pairs), "label int, features array<int>")
    found = made.toArrow()
    labels = found.column("label").to_numpy()
    parts = [c for c in found.column("features").chunks if len(c)]
    if not parts:
        return labels, Rows.of([])
    lists = pa.concat_arrays(parts)
    starts = lists.offsets.to_numpy()
    return labels, Rows(starts - starts[0], lists.values.to_numpy()[starts[0] : starts[-1]])


def training_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the labelled rows that models may learn from; null ids and labels are none."""
    return labels.where(~held_out() & F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")
    )
