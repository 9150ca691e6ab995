"""Timestamps as numbers.

A timestamp without zone is read field by field, as if it were UTC: a cast would pass it through the
session zone, whose clock changes move some times and reorder others.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ZONE = "timestamp_ntz"


def micros(ts: Column, kind: str) -> Column:
    if kind != NO_ZONE:
        return F.unix_micros(ts)
    day = F.unix_date(ts.cast("date")).cast("bigint")
    minute = day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    within = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return minute * 1_000_000 + within


def from_micros(at: Column, kind: str) -> Column:
    if kind != NO_ZONE:
        return F.timestamp_micros(at)
    since = F.make_dt_interval(secs=(at / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)"))
    return F.lit("1970-01-01").cast(NO_ZONE) + since
