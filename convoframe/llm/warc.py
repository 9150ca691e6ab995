"""Web archives of page captures, with one index of all captures in the order of URL key and time.

Writing. Payloads that several captures share (at least ``min_bytes`` long) are stored once: the capture with
the least id is a ``response`` record, the others are ``revisit`` records that name it. Each task writes its
records into one archive, every record a gzip member of its own, so that a reader can fetch any of them by its
place. Beside the archive a task writes *runs*: its captures sorted by (URL key, time, id), ``RUN`` at a time,
as an Arrow file of small batches.

Index. The runs of all tasks are merged into one order. Cut keys, taken from a bounded sample of the runs'
batches, divide the order into ranges; the batches' first keys tell which of them a range needs from a run.
Within a range a loser tree merges the slices: its leaves are the runs' heads, every inner node keeps the loser
of its match, and the winner's slice is taken up to the runner-up's key before its path is played again. A task
merges at most ``FAN_IN`` slices and holds a batch of each; more are merged in rounds, first in wide ranges,
then in narrower ones. The last round's files, in the order of their ranges, are the index: captures of one URL
lie together in the order of time.

Lost executors: a task that is run again writes files of new names; tables written by Spark name those that
count.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convoframe.llm.common import small_batches
from convoframe.session import materialise, scratch_path

MIN_BYTES = 100
# Captures in a run, and in one of its batches.
RUN = 65_536
BATCH = 1_024
FAN_IN = 64
# Captures in a range of the index, about, and ranges that the first round of merges may have.
RANGE = 262_144
FIRST_RANGES = 16
# Batches whose first keys the cuts are taken from.
SAMPLE = 10_000
# Shared payloads that are broadcast (some 150 bytes and a URL each); more are joined by a shuffle.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 8_000_000

CAPTURE = pa.schema(
    [
        ("urlkey", pa.string()),
        ("time", pa.string()),
        ("page_id", pa.int64()),
        ("row", pa.int64()),
        ("url", pa.string()),
        ("digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
    ]
)
INDEX = (
    "urlkey string, time string, page_id long, row long, url string, digest string, record_type string, "
    "refers_to long, file string, offset long, length long"
)
# A run: where it is, the range it is in (null: any), its captures, and its batches' first keys.
RUNS = "run string, at int, captures long, firsts array<string>"
RECORDS = "page_id long, url string, time string, payload_bytes long, payload_digest string, record_type string, refers_to long"

_HOST = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#]*)")
_DROPPED = re.compile(r"^www\d*\.")
_PORT = re.compile(r":(?:80|443)?$")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str) -> str:
    """The key that a URL is ordered by: its host's labels reversed, then path and sorted query, lowered.

    Scheme, user, ``www``, usual ports and fragment are dropped, and so is a last slash of the path. What has
    no host is its own key.
    """
    url = url.split("#", 1)[0].lower()
    host = _HOST.match(url)
    if not host:
        return url
    path, _, query = url[host.end() :].partition("?")
    labels = _PORT.sub("", _DROPPED.sub("", host[1])).split(".")
    asked = "?" + "&".join(sorted(query.split("&"))) if query else ""
    return ",".join(reversed(labels)) + ")" + (path.rstrip("/") or "/") + asked


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{row}')}>"


def _safe(url: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


def record(capture: dict, payload: bytes) -> bytes:
    """One record: headers, the HTTP headers of the capture and, for a response, its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = capture["record_type"] == "revisit"
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {capture['record_type']}",
        f"WARC-Record-ID: {record_id(capture['page_id'], capture['row'])}",
        f"WARC-Date: {capture['time']}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{capture['digest']}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if capture["url"]:
        lines.append(f"WARC-Target-URI: {_safe(capture['url'])}")
    if capture["page_id"] is not None:
        lines.append(f"X-Page-ID: {capture['page_id']}")
    if revisit:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: {record_id(capture['first_id'], capture['first_row'])}")
        lines.append(f"WARC-Refers-To-Date: {capture['first_time']}")
        if capture["first_url"]:
            lines.append(f"WARC-Refers-To-Target-URI: {_safe(capture['first_url'])}")
        if capture["first_id"] is not None:
            lines.append(f"X-Refers-To-Page-ID: {capture['first_id']}")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers of a record, its HTTP headers and its payload; refuses a wrong length or digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    block, tail = rest[: int(headers["Content-Length"])], rest[int(headers["Content-Length"]) :]
    if not version.startswith("WARC/") or tail != b"\r\n\r\n":
        raise ValueError(f"bad record {headers.get('WARC-Record-ID')}")
    if headers["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _key(capture: dict) -> tuple:
    """The order of captures: URL key, time, id (null last), row."""
    return capture["urlkey"], capture["time"], capture["page_id"] is None, capture["page_id"] or 0, capture["row"]


def _cut(urlkey: str, time: str) -> str:
    """URL key and time as one text of the same order; cuts divide by it."""
    return f"{urlkey}\0{time}"


class RunWriter:
    """Writes captures, which come in order, as an Arrow file of small batches."""

    def __init__(self, store: pafs.FileSystem, path: str, batch: int):
        self.batch = batch
        self.sink = store.open_output_stream(path)
        self.out = pa.ipc.new_file(self.sink, CAPTURE)
        self.firsts: list[str] = []
        self.captures = 0
        self.held: list[dict] = []

    def add(self, captures: list[dict]) -> None:
        self.held += captures
        while len(self.held) >= self.batch:
            self._write(self.held[: self.batch])
            del self.held[: self.batch]

    def _write(self, captures: list[dict]) -> None:
        self.out.write_batch(pa.RecordBatch.from_pylist(captures, CAPTURE))
        self.firsts.append(_cut(captures[0]["urlkey"], captures[0]["time"]))
        self.captures += len(captures)

    def close(self, name: str, at: int | None) -> dict:
        if self.held:
            self._write(self.held)
        self.out.close()
        self.sink.close()
        return {"run": name, "at": at, "captures": self.captures, "firsts": self.firsts}


_RUN_ROWS = pa.schema([("run", pa.string()), ("at", pa.int32()), ("captures", pa.int64()), ("firsts", pa.list_(pa.string()))])


def _archiver(folder: str, run: int, batch_rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        name = f"captures-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        out, at, captures = None, 0, []

        def sorted_run() -> pa.RecordBatch:
            own = f"{uuid.uuid4().hex}.run"
            writer = RunWriter(store, f"{path}/{own}", batch_rows)
            writer.add(sorted(captures, key=_key))
            captures.clear()
            return pa.RecordBatch.from_pylist([writer.close(own, None)], _RUN_ROWS)

        for whole in batches:
            for batch in small_batches([whole], "payload", 1_000_000):
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                for capture in batch.to_pylist():
                    member = gzip.compress(record(capture, capture.pop("payload").encode()), 5, mtime=0)
                    out.write(member)
                    place = {"urlkey": url_key(capture["url"]), "file": f"{name}.warc.gz", "offset": at, "length": len(member)}
                    captures.append({k: v for k, v in (capture | place).items() if not k.startswith("first_")})
                    captures[-1]["refers_to"] = capture["first_id"]
                    at += len(member)
                    if len(captures) >= run:
                        yield sorted_run()
        if out is not None:
            out.close()
            if captures:
                yield sorted_run()

    return work


class LoserTree:
    """Merges sorted runs: ``play`` gives the run with the least head, each match's loser stays in its node."""

    def __init__(self, heads: list[tuple | None]):
        self.size = max(1, len(heads))
        self.heads = list(heads) or [None]
        self.losers = [-1] * self.size
        for leaf in range(self.size):
            self.replay(leaf, building=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None if x is None or y is None else (x, a) < (y, b)

    def replay(self, leaf: int, building: bool = False) -> None:
        """Plays a leaf's matches up to the root again; an empty run (null head) loses to all."""
        winner, node = leaf, (leaf + self.size) // 2
        while node:
            other = self.losers[node]
            if other < 0 and building:
                self.losers[node] = winner
                return
            if other >= 0 and self._less(other, winner):
                winner, self.losers[node] = other, winner
            node //= 2
        self.losers[0] = winner

    @property
    def winner(self) -> int:
        return self.losers[0]

    def runner_up(self) -> tuple | None:
        """The least head but the winner's: one of the losers on the winner's path."""
        node, best = (self.winner + self.size) // 2, None
        while node:
            if best is None or self._less(self.losers[node], best):
                best = self.losers[node]
            node //= 2
        return None if best is None else self.heads[best]


class Slice:
    """The part of a run that lies in a range, a batch at a time."""

    def __init__(self, store: pafs.FileSystem, path: str, start: int, after: int, low: str | None, high: str | None):
        self.file = store.open_input_file(path)
        self.reader = pa.ipc.open_file(self.file)
        self.low, self.high = low, high
        self.next, self.end = start, after
        self.rows: list[dict] = []
        self.keys: list[tuple] = []
        self.at = 0
        self._read()

    def _inside(self, row: dict) -> bool:
        cut = _cut(row["urlkey"], row["time"])
        return (self.low is None or cut >= self.low) and (self.high is None or cut < self.high)

    def _read(self) -> None:
        self.rows, self.at = [], 0
        while not self.rows and self.next < self.end:
            self.rows = [r for r in self.reader.get_batch(self.next).to_pylist() if self._inside(r)]
            self.next += 1
        self.keys = [_key(r) for r in self.rows]
        if not self.rows:
            self.file.close()

    @property
    def head(self) -> tuple | None:
        return self.keys[self.at] if self.at < len(self.keys) else None

    def take(self, until: tuple | None) -> list[dict]:
        """Rows of the batch at hand up to a key, one at the least."""
        end = len(self.keys) if until is None else max(self.at + 1, bisect.bisect_right(self.keys, until, self.at))
        out, self.at = self.rows[self.at : end], end
        if self.at >= len(self.keys):
            self._read()
        return out


def merge(slices: list[Slice]) -> Iterator[list[dict]]:
    """All rows of sorted slices in order, some at a time."""
    tree = LoserTree([s.head for s in slices])
    while slices and slices[tree.winner].head is not None:
        winner = tree.winner
        yield slices[winner].take(tree.runner_up())
        tree.heads[winner] = slices[winner].head
        tree.replay(winner)


def _merger(folder: str, cuts: list[str], batch_rows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for job in batch.to_pylist():
                low = cuts[job["at"] - 1] if job["at"] else None
                high = cuts[job["at"]] if job["at"] < len(cuts) else None
                own = f"{uuid.uuid4().hex}.run"
                writer = RunWriter(store, f"{path}/{own}", batch_rows)
                slices = [Slice(store, f"{path}/{r['run']}", r["start"], r["after"], low, high) for r in job["runs"]]
                for rows in merge(slices):
                    writer.add(rows)
                yield pa.RecordBatch.from_pylist([writer.close(own, job["at"])], _RUN_ROWS)

    return work


def _cuts(runs: DataFrame, captures: int, per_range: int) -> list[str]:
    """At most one cut for each ``per_range`` captures, from a bounded sample of the batches' first keys."""
    firsts = runs.select("run", F.posexplode("firsts").alias("i", "first"))
    sample = [r["first"] for r in firsts.orderBy(F.xxhash64("run", "i")).limit(SAMPLE).select("first").collect()]
    ranges = min(len(sample), -(-captures // per_range))
    sample.sort()
    return sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)})


def merge_runs(folder: str, runs: DataFrame, fan_in: int = FAN_IN, per_range: int = RANGE, batch: int = BATCH) -> DataFrame:
    """The runs of the whole order, one for each range: (run, at, captures, firsts), ``at`` from 0 in order.

    A round takes every ``fan_in``-th cut of the next one's, so that a slice holds many batches of its run and
    a merge has about as many captures in each round.
    """
    captures = runs.agg(F.coalesce(F.sum("captures"), F.lit(0))).first()[0]
    every = _cuts(runs, captures, per_range)
    stride = 1
    while len(every) // stride >= FIRST_RANGES:
        stride *= fan_in
    left, wider = runs.withColumn("at", F.lit(0)), max(1, len(every) + 1)
    while True:
        cuts = every[stride - 1 :: stride]
        held = F.lit(cuts).cast("array<string>")
        low, high = F.get(held, F.col("at") - 1), F.get(held, F.col("at"))
        before = lambda key: F.size(F.filter("firsts", lambda f: f < key))
        # From the range of the run's first key to the end of the wider range that it was merged for.
        begin = F.size(F.filter(held, lambda c: c <= F.get("firsts", F.lit(0))))
        end = F.least(F.lit(len(cuts)), (F.col("at") + 1) * wider - 1)
        slices = left.where("captures > 0").select("run", "firsts", F.explode(F.sequence(begin, end)).alias("at"))
        slices = slices.select(
            "at",
            "run",
            # Equal keys may begin in the batch before the first that reaches the cut.
            F.when(low.isNull(), 0).otherwise(F.greatest(F.lit(0), before(low) - 1)).alias("start"),
            F.when(high.isNull(), F.size("firsts")).otherwise(before(high)).alias("after"),
        ).where("start < after")
        number = F.row_number().over(Window.partitionBy("at").orderBy("run")) - 1
        jobs = slices.withColumn("group", F.floor(number / fan_in)).groupBy("at", "group")
        jobs = materialise(jobs.agg(F.collect_list(F.struct("run", "start", "after")).alias("runs")), "jobs")
        dealt = jobs.repartition(max(1, jobs.count()), "at", "group")
        merged = materialise(dealt.mapInArrow(_merger(folder, cuts, batch), RUNS), "merged")
        left = merged.where("captures > 0")
        if stride == 1 and left.groupBy("at").count().where("count > 1").isEmpty():
            return left
        wider, stride = (fan_in, stride // fan_in) if stride > 1 else (1, 1)


def _index_reader(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for run in batch.column(0).to_pylist():
                with store.open_input_file(f"{path}/{run}") as file:
                    reader = pa.ipc.open_file(file)
                    for k in range(reader.num_record_batches):
                        yield reader.get_batch(k)

    return work


def read_index(folder: str, index: DataFrame) -> DataFrame:
    """The captures of a merged index, those of each range in order within one partition."""
    files = index.select("run").repartition(max(1, index.count()), "run")
    return files.mapInArrow(_index_reader(folder), INDEX)


def _record_reader(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for batch in batches:
            rows = []
            for capture in batch.to_pylist():
                if capture["file"] != name:
                    if file is not None:
                        file.close()
                    name = capture["file"]
                    file = store.open_input_file(f"{path}/{name}")
                headers, http, payload = parse(gzip.decompress(file.read_at(capture["length"], capture["offset"])))
                size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if headers["WARC-Type"] == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                    raise ValueError(f"damaged payload of {headers['WARC-Record-ID']}")
                ids = [headers.get(k) for k in ("X-Page-ID", "X-Refers-To-Page-ID")]
                page, first = (None if i is None else int(i) for i in ids)
                rows.append((page, headers.get("WARC-Target-URI"), headers["WARC-Date"], size, digest, headers["WARC-Type"], first))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "url", "time", "payload_bytes", "payload_digest", "record_type", "refers_to"]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
        if file is not None:
            file.close()

    return work


def read_records(folder: str, captures: DataFrame) -> DataFrame:
    """The records that captures of an index name, read from the archives and proved by their digests."""
    place = ["file", F.floor(F.col("offset") / (64 << 20))]
    near = captures.select("file", "offset", "length").repartition(*place).sortWithinPartitions("file", "offset")
    return near.mapInArrow(_record_reader(folder), RECORDS)


def _small(df: DataFrame) -> DataFrame:
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("first.url")), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def write_archives(
    pages: DataFrame,
    time: Column | None = None,
    folder: str | None = None,
    min_bytes: int = MIN_BYTES,
    run: int = RUN,
    fan_in: int = FAN_IN,
    per_range: int = RANGE,
    batch: int = BATCH,
) -> tuple[str, DataFrame]:
    """Archives and index of ``pages`` (page_id, url, html): (folder, index of ``merge_runs``).

    ``time`` is the capture's timestamp; without it, or where it is null, 1970 stands. Null html is an empty
    payload, a null URL an empty one without a header. Of equal payloads of ``min_bytes`` or more, the least
    page_id stays a response, null ids being last and, among rows that repeat an id, the first row read. Each
    row makes a record, rows that repeat others too. Captures of equal URL key and time go by page_id.
    Blanks and control characters of a URL are percent-encoded in the headers. Texts may have any length: a
    task holds 1 MB of them, or one. Other columns are not looked at. No rows give an index of no runs.
    """
    spark = pages.sparkSession
    folder = folder or scratch_path(spark, "archives")
    stamp = F.coalesce((F.lit(None) if time is None else time).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.date_format(F.to_utc_timestamp(stamp, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("time"),
        F.sha2(payload, 256).alias("digest"),
        F.octet_length(payload).alias("size"),
        F.monotonically_increasing_id().alias("row"),
        payload.alias("payload"),
    )
    # Written once: a row's number must be the same where payloads are compared and where they are stored.
    rows = materialise(rows, "captures")
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row", "time", "url")).alias("first")
    shared = rows.where(F.col("size") >= min_bytes).groupBy("digest", "size").agg(first, F.count(F.lit(1)).alias("copies"))
    shared = materialise(shared.where("copies > 1").drop("copies"), "shared")
    joined = rows.join(_small(shared), ["digest", "size"], "left")
    revisit = F.col("first.row") != F.col("row")
    named = {"first_id": "page_id", "first_row": "row", "first_time": "time", "first_url": "url"}
    captures = joined.select(
        "page_id",
        "url",
        "time",
        "row",
        "digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        *[F.when(revisit, F.col(f"first.{old}")).alias(new) for new, old in named.items()],
        "payload",
    )
    runs = materialise(captures.mapInArrow(_archiver(folder, run, batch), RUNS), "runs")
    return folder, merge_runs(folder, runs, fan_in, per_range, batch)
