"""Token ids in length-delimited binary record files with an offset index.

A record file holds, for each document in ascending id order:

    length of the payload, 8 bytes | masked checksum of those 8 bytes, 4 bytes
    payload                        | masked checksum of the payload, 4 bytes

All numbers are little-endian. A checksum is CRC-32, masked as ((crc >> 15) | (crc << 17)) + 0xA282EAD8
modulo 2^32, so that a checksum over data that holds checksums stays useful. A payload is the id's flag
(0 null, 1 given), the id (8 bytes), the width of a token id (2 or 4) and the token ids. Beside each file
stands an index: magic, number of records, then for each record its offset in the file, its token count and
the first token's place in the file (8 bytes each), and a masked checksum of all of it. A reader can so
fetch any record alone, in any order.

Each task writes its files under names of its own; a manifest, written by Spark when all tasks are done,
names those that count. A task that is run again leaves files that no manifest names.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoframe.llm.common import small_batches, split_words
from convoframe.llm.features import spread
from convoframe.session import materialise, scratch_path

MAGIC = b"RECIDX01"
END_ID = 2

MANIFEST = "part int, file string, docs long, tokens long, bytes long"

# Letters whose upper and lower case, and whose class, no tokenizer library disputes.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:|#$%&*]*)")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class TextEncoder:
    """Ids of whole texts as the library gives them, each distinct word being encoded once.

    Texts are cut at ASCII white space, which this vocabulary's tokens never hold. A word of plain letters
    and a tail of signs are looked up apart; any other chunk is given to the library as it is.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.letters = _byte_letters()
        self.words: dict[str, list[int]] = {}

    def _word(self, word: str) -> list[int]:
        ids = self.words.get(word)
        if ids is None:
            spelled = word if word.isascii() else "".join(self.letters[b] for b in word.encode())
            ids = self.words[word] = [t.id for t in self.tokenizer.model.tokenize(spelled)]
        return ids

    def _chunk(self, chunk: str) -> list[int]:
        ids = self.words.get("\0" + chunk)
        if ids is None:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            self.words["\0" + chunk] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row offsets, ids) of the texts; null counts as empty."""
        if len(self.words) > 1_000_000:
            self.words.clear()
        offsets, codes, words = split_words(texts, lower=False)
        flat, ends = array("I"), [0]
        for chunk in words.to_pylist():
            plain = _PLAIN.fullmatch(chunk)
            if plain:
                flat.extend(self._word(plain[1].lower()))
                if plain[2]:
                    flat.extend(self._chunk(plain[2]))
            else:
                flat.extend(self._chunk(chunk))
            ends.append(len(flat))
        starts = np.array(ends)
        _, at = spread(codes, starts)
        counts = np.concatenate([[0], np.cumsum((starts[1:] - starts[:-1])[codes])])
        return counts[offsets], np.frombuffer(flat, dtype=np.uint32)[at] if len(flat) else at.astype(np.uint32)


def payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    head = struct.pack("<BqB", doc_id is not None, doc_id or 0, width)
    return head + ids.astype(f"<u{width}").tobytes()


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    given, doc_id, width = struct.unpack_from("<BqB", data)
    return (doc_id if given else None), np.frombuffer(data, f"<u{width}", offset=10).astype(np.uint32)


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return length + struct.pack("<I", masked(length)) + data + struct.pack("<I", masked(data))


def unframe(data: memoryview, at: int = 0) -> tuple[bytes, int]:
    """The payload at an offset and the offset after it; refuses wrong checksums and lengths."""
    head = bytes(data[at : at + 12])
    if len(head) < 12 or masked(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
        raise ValueError(f"bad record length at {at}")
    end = at + 12 + struct.unpack_from("<Q", head)[0]
    body = bytes(data[at + 12 : end])
    tail = bytes(data[end : end + 4])
    if len(tail) < 4 or masked(body) != struct.unpack("<I", tail)[0]:
        raise ValueError(f"bad record at {at}")
    return body, end + 4


def write_index(rows: list[tuple[int, int, int]]) -> bytes:
    body = MAGIC + struct.pack("<Q", len(rows)) + np.array(rows, dtype="<u8").tobytes()
    return body + struct.pack("<I", masked(body))


def read_index(data: bytes) -> np.ndarray:
    """One row (offset, tokens, first token) for each record."""
    if data[:8] != MAGIC or masked(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise ValueError("bad index")
    return np.frombuffer(data[16:-4], dtype="<u8").reshape(-1, 3).astype(np.int64)


def _writer(folder: str, file: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        encoder, out = None, None
        index, at, total = [], 0, 0
        for whole in batches:
            for batch in small_batches([whole], "text"):
                if out is None:
                    encoder = TextEncoder(file)
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}.rec")
                offsets, ids = encoder.encode(batch.column(1))
                for row, doc_id in enumerate(batch.column(0).to_pylist()):
                    own = np.append(ids[offsets[row] : offsets[row + 1]], np.uint32(end_id))
                    record = frame(payload(doc_id, own))
                    index.append((at, len(own), total))
                    out.write(record)
                    at += len(record)
                    total += len(own)
        if out is not None:
            out.close()
            with store.open_output_stream(f"{path}/{name}.idx") as beside:
                beside.write(write_index(index))
            row = [[part], [name], [len(index)], [total], [at]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [pa.array(x, k) for x, k in zip(row, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "file", "docs", "tokens", "bytes"])

    return run


def write_records(docs: DataFrame, file: str, folder: str | None = None, end_id: int = END_ID) -> tuple[str, DataFrame]:
    """Encodes (doc_id, text) and writes record files in ascending id order: (folder, manifest).

    Each document's ids are followed by ``end_id``. Null and empty texts give that id alone. Null ids come
    first. Rows that repeat an id stand beside each other, in the order of a hash of their texts.
    ``file`` is a tokenizer file that every executor has; ``folder`` must be one that all share. Texts may have any
    length: a task holds 8 MB of them, or one. No rows give no files and an empty manifest. Other columns are not
    looked at, whatever their names.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "records")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = source.repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = dealt.mapInArrow(_writer(folder, file, end_id), MANIFEST)
    return folder, materialise(manifest, "manifest", f"{folder}/manifest")


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(f"{path}/{row['file']}.idx") as beside:
                    index = read_index(beside.read())
                out: list[list] = [[], [], [], []]
                with store.open_input_file(f"{path}/{row['file']}.rec") as records:
                    ends = np.append(index[1:, 0], row["bytes"])
                    for (at, tokens, first), end in zip(index.tolist(), ends.tolist(), strict=True):
                        body, _ = unframe(memoryview(records.read_at(end - at, at)))
                        doc_id, ids = parse(body)
                        if len(ids) != tokens:
                            raise ValueError(f"{row['file']} and its index differ at {at}")
                        values = (doc_id, row["start"] + first, tokens, zlib.crc32(ids.astype("<u4").tobytes()))
                        for column, value in zip(out, values, strict=True):
                            column.append(value)
                arrays = [pa.array(c, pa.int64()) for c in out]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_records(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each record of the files: doc_id, start (tokens before it), n_tokens, ids_crc32.

    Every checksum is proved; a damaged file fails the job. Null ids come back as null; an empty manifest gives no
    rows.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select(
        "part", "file", "bytes", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("start")
    )
    # One task for each file; a repartition without a number would be merged to one task for all.
    files = placed.repartition(max(1, manifest.count()))
    return files.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_one(folder: str, name: str, record: int) -> tuple[int | None, np.ndarray]:
    """One record of a file by its place, through the index: for reads in shuffled order."""
    store, path = pafs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{path}/{name}.idx") as beside:
        index = read_index(beside.read())
    with store.open_input_file(f"{path}/{name}.rec") as records:
        at = int(index[record, 0])
        end = int(index[record + 1, 0]) if record + 1 < len(index) else records.size()
        return parse(unframe(memoryview(records.read_at(end - at, at)))[0])
