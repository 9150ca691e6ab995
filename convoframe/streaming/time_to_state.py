"""Time until an app is up, as a stream."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convoframe.functions import times


class _Waits(StatefulProcessor):
    """The open starts of a group of apps and the ready times that a start still to come may look for.

    State: each open start's app, tie and time and the first ready time known for it so far; ready times after the
    watermark; the timer. It is one value for many apps, as every call of this class and every access to the store
    leaves the worker. A start is decided once the watermark has passed its ready time or its timeout, as no row can
    arrive then that changes the answer. One timer waits for the earliest such moment.
    """

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        text, number = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
        kinds = {"whos": text, "ties": text, "ats": number, "ups": number, "up_whos": text, "up_ats": number}
        fields = [T.StructField(name, kind) for name, kind in kinds.items()]
        self.waits = handle.getValueState("waits", T.StructType([*fields, T.StructField("timer", T.LongType())]))

    def _read(self) -> tuple[list[tuple], list[tuple], int | None]:
        """Open starts (app, tie, time, first ready time), ready times (app, time) and the timer."""
        kept = self.waits.get()
        if kept is None:
            return [], [], None
        return list(zip(*kept[:4])), list(zip(*kept[4:6])), kept[6]

    def _write(self, starts: list[tuple], ups: list[tuple], timer: int | None) -> None:
        """The state, with one timer at the earliest deadline (in microseconds)."""
        deadlines = [at + self.timeout if up is None else up for _, _, at, up in starts]
        due = -(-min(deadlines) // 1000) if deadlines else None
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if starts or ups:
            columns = [[row[i] for row in rows] for rows, width in ((starts, 4), (ups, 2)) for i in range(width)]
            self.waits.update((*columns, due))
        else:
            self.waits.clear()

    def _first_after(self, at: int, ups: list[int]) -> int | None:
        place = bisect.bisect_right(ups, at)
        return ups[place] if place < len(ups) and ups[place] <= at + self.timeout else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        starts: list[tuple] = []
        new_ups: set[tuple] = set()
        for part in rows:
            ready, own = part["ready"].to_numpy(dtype=bool), part["own"].to_numpy(dtype=bool)
            who, tie, at = (part[c].to_numpy() for c in ("who", "tie", "at"))
            new_ups.update(zip(who[ready].tolist(), at[ready].tolist()))
            starts += zip(who[own].tolist(), tie[own].tolist(), at[own].tolist())
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        opened, held, timer = self._read()
        fresh, every = {}, {}
        for found, pairs in ((fresh, new_ups), (every, new_ups.union(held))):
            for who, at in sorted(pairs, key=lambda pair: pair[1]):
                found.setdefault(who, []).append(at)
        still = []
        for who, tie, at, up in opened:
            found = self._first_after(at, fresh.get(who, []))
            still.append((who, tie, at, found if up is None else up if found is None else min(up, found)))
        still += [(who, tie, at, self._first_after(at, every.get(who, []))) for who, tie, at in starts]
        # Starts that are still to come lie after the watermark, and so do their ready times.
        self._write(still, [(who, at) for who, ats in every.items() for at in ats if at > passed], timer)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        opened, held, _ = self._read()
        still, decided = [], []
        for start in opened:
            _, _, at, up = start
            due = at + self.timeout if up is None else up
            (decided if due <= passed else still).append(start)
        # The timer that went off is gone.
        self._write(still, [(who, at) for who, at in held if at > passed], None)
        out = pd.DataFrame(decided, columns=["who", "tie", "at", "up"])
        yield out.astype({"at": "int64", "up": "Int64"})

    def close(self) -> None:
        pass


def stream_time_to_state(
    status: DataFrame,
    start: Column,
    ready: Column,
    timeout: int = 300,
    delay: str = "1 minute",
    salts: int = 4,
    groups: int = 512,
    by: str = "app_id",
    ts: str = "ts",
    tie: str = "event_id",
) -> DataFrame:
    """The rows of ``time_to_state`` for a stream, in append mode: ``by, tie, start_ts, outcome, ready_ts``.

    A start comes out when the watermark passes its ready time or, without one, its timeout; not earlier, as
    rows may arrive in any order within ``delay``. Rows later than that may be dropped. Rows without a time are
    neither starts nor ready.

    The state of an app is its open starts and the ready times after the watermark. Starts are spread over
    ``salts`` parts, so that a busy app is not one task's work; each part needs the app's ready times. Parts are dealt
    to ``groups``, each with one state; raise it where a group's open starts grow to many megabytes. The session must name the RocksDB state store when the query starts, as ``build_session`` does.
    """
    types = dict(status.dtypes)
    kind = types[ts]
    # Watermarks need an instant; a time without zone counts as UTC and is turned back below.
    event_time = F.timestamp_micros(times.micros(F.col(ts), kind))
    is_start, is_ready = F.coalesce(start, F.lit(False)), F.coalesce(ready, F.lit(False))
    own_salt = F.when(is_start, F.pmod(F.xxhash64(tie), F.lit(salts)).cast("int"))
    every_salt = F.when(is_ready, F.sequence(F.lit(0), F.lit(salts - 1)))
    # Texts carry any type of key and tie through the state, nulls included.
    rows = (
        status.where((is_start | is_ready) & F.col(ts).isNotNull())
        .select(
            F.col(by).cast("string").alias("who"),
            F.col(tie).cast("string").alias("tie"),
            event_time.alias("moment"),
            is_ready.alias("ready"),
            own_salt.alias("own_salt"),
            F.explode(F.coalesce(every_salt, F.array(own_salt))).alias("salt"),
        )
        .withColumn("group", F.pmod(F.xxhash64("who", "salt"), F.lit(groups)).cast("int"))
        .withWatermark("moment", delay)
    )
    own = F.coalesce(F.col("own_salt") == F.col("salt"), F.lit(False))
    rows = rows.select("group", "who", "tie", "moment", F.unix_micros("moment").alias("at"), "ready", own.alias("own"))
    decided = rows.groupBy("group").transformWithStateInPandas(
        _Waits(timeout * 1_000_000), "who string, tie string, at long, up long", "append", "eventTime"
    )
    return decided.select(
        F.col("who").cast(types[by]).alias(by),
        F.col("tie").cast(types[tie]).alias(tie),
        times.from_micros(F.col("at"), kind).alias("start_ts"),
        F.when(F.col("up").isNotNull(), "ready").otherwise("timeout").alias("outcome"),
        times.from_micros(F.col("up"), kind).alias("ready_ts"),
    )
