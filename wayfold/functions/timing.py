"""Known and finite measures, checked values, windows and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_SECONDS = 600


def known(x: Column) -> Column:
    """Neither null nor NaN."""
    return x.isNotNull() & ~F.isnan(x)


def finite(x: Column) -> Column:
    return known(x) & (F.abs(x) != float("inf"))


def checked(value: Column, ok: Column, message: str) -> Column:
    """value where ok holds, an error elsewhere. A last guard only: an unused column is pruned with its check."""
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)))


def window_start(seconds: Column, size: int = WINDOW_SECONDS) -> Column:
    return (F.floor(seconds / size) * size).cast("long")


def local_day(seconds: Column) -> Column:
    """yyyyMMdd in the session's zone."""
    return F.from_unixtime(seconds, "yyyyMMdd")


def hour_of_day(seconds: Column, offset_hours: int = 8) -> Column:
    return F.pmod(F.floor(seconds / 3600) + offset_hours, F.lit(24)).cast("int")


def hour_slot(window: Column, size: int = WINDOW_SECONDS) -> Column:
    """Number of a window within its hour."""
    return F.floor(F.pmod(window, F.lit(3600)) / size).cast("int")


def delta_bucket(dt: Column) -> Column:
    """30-second bucket of the offset in a window, 0 to 19."""
    return F.least(F.floor(dt / 30), F.lit(19)).cast("int")


def cell_key(*parts: Column) -> Column:
    """64-bit routing key of a cell; a null part is kept apart from an absent one."""
    return F.xxhash64(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts]))


def bucket(cell_id: Column, buckets: int = 128) -> Column:
    return F.pmod(cell_id, F.lit(buckets)).cast("int")


def seeded(seed, *parts: Column) -> Column:
    """Order that reruns and other engines repeat: md5 of the seed and the key parts."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def json_safe(x: Column) -> Column:
    """NaN and infinities as null."""
    return F.when(finite(x), x)


def safe_ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """a / b rounded, null where b is 0."""
    return F.round(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), digits)
