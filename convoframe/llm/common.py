"""Helpers of the operators in this package."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The labelled fold that models may not learn from: crc32 of the id as text, modulo 4.
FOLDS = 4
HELD_OUT = 2

U64 = np.uint64

# Text in a batch whose features are made at once: they take some 80 times its bytes.
FEATURE_BYTES = 1_000_000

# Bytes in a batch of rows on its way to a Python worker.
WORKER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
WORKER_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a row belongs to the fold that no model learns labels from; a null id does."""
    fold = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT
    return F.coalesce(fold, F.lit(True))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def hash_words(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string's bytes, the same in every process."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between runs of ASCII white space: (row offsets, code of each word, distinct words).

    With ``lower``, A-Z become a-z and nothing else changes.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    # Leading and trailing white space would give empty words.
    lists = pc.ascii_split_whitespace(pc.ascii_trim(texts, " \t\n\v\f\r"))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
    offsets = offsets - offsets[0]
    codes = coded.indices.to_numpy(zero_copy_only=False)
    words = coded.dictionary
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if empty.any():
        keep = ~empty[codes]
        lengths = np.concatenate([[0], np.cumsum(keep)])
        offsets = lengths[offsets]
        codes = codes[keep]
    return offsets, codes, words


@functools.cache
def _trim():
    """The C library's function that gives free memory back to the system; none where it has no such one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Gives the memory that this process has freed back to the system, so that a worker that is kept for the
    next stage does not hold this one's."""
    pa.default_memory_pool().release_unused()
    trim = _trim()
    if trim:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """From now on rows go to Python workers in batches of ``WORKER_BYTES``, unless the session names a size.

    Spark's own bound is 64 MB, which the executor and the worker each hold for every task.
    """
    if WORKER_BATCH not in spark.conf.getAll:
        spark.conf.set(WORKER_BATCH, str(WORKER_BYTES))


def small_batches(
    batches: Iterator[pa.RecordBatch], column: str, limit: int = 8_000_000
) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``limit`` bytes in the text column, one row at the least."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        sizes = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes):
            if row > start and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
        give_back()


def sum_by_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of consecutive ranges; 0 for an empty range."""
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]
