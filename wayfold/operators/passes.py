"""Raw records of passes over road segments to one row per pass, under the data contract.

A raw record says where a vehicle was: map, link, sample, segment, mark, place (record bin), part (order within the bin),
reference (time of the sample in epoch seconds), since (seconds from the reference to the end of the part), spent (seconds in
the part), share (of the bin's ten metres) and gps (seen directly).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timing import bucket, cell_key, checked, finite, known, local_day, window_start

#: Fixed by the data contract: bins of a segment, and the lead of the first segment in record bins.
SEGMENT_BINS, LEAD_BINS = 50, 10
PASS = ["map", "link", "sample", "segment"]


def marked_parts(raw: DataFrame) -> DataFrame:
    """The marked records with bin (0 to 49), tenths (1 to 10), timed, spent and begin; a breach of the contract is an error.

    A part is timed if `spent` is known; it must then be finite and not negative. begin = since - spent where both are
    known. The reference time must be finite, for it dates the whole pass.
    """
    reference, since, spent = F.col("reference"), F.col("since"), F.col("spent")
    place = F.col("place") - SEGMENT_BINS * F.col("segment") - LEAD_BINS
    tenths = F.round(10 * F.col("share"))
    timed = known(spent)
    rules: dict[str, tuple[Column, Column, str]] = {
        "reference": (reference, finite(reference), "the reference time is not finite"),
        "bin": (place.cast("int"), place.between(0, SEGMENT_BINS - 1), "bin outside 0..49"),
        "tenths": (tenths.cast("int"), tenths.between(1, 10), "share outside 1 to 10 tenths"),
        "spent": (spent, ~timed | (finite(spent) & (spent >= 0)), "a time spent is negative or not finite"),
        "since": (since, ~known(since) | finite(since), "a time since the reference is not finite"),
    }
    rows = raw.where("mark = 1").withColumn("timed", timed)
    rows = rows.withColumns({name: checked(value, F.coalesce(ok, F.lit(False)), message) for name, (value, ok, message) in rules.items()})
    return rows.withColumn("begin", F.when(F.col("timed") & known(F.col("since")), F.col("since") - F.col("spent")))


def observations(raw: DataFrame, buckets: int = 128) -> DataFrame:
    """One row per pass: its parts in the order of bin and part as aligned arrays, and when and in which cell it entered.

    A pass enters at the reference time plus the earliest known begin of a part, so a part without a time does not hide
    it; a pass without any known begin is dropped. Untimed parts have NaN in `spent`. Repeated records count again.
    """
    part = F.struct("bin", "part", F.when(F.col("timed"), F.col("spent")).otherwise(F.lit(float("nan"))).cast("float").alias("spent"), "tenths", F.coalesce("gps", F.lit(False)).alias("gps"), "timed")
    passes = marked_parts(raw).groupBy(*PASS).agg(F.max("reference").alias("reference"), F.min("begin").alias("begin"), F.array_sort(F.collect_list(part)).alias("parts"))
    entry = F.col("reference") + F.col("begin")
    passes = passes.where("begin is not null").withColumn("window", window_start(entry)).withColumn("offset", (entry - F.col("window")).cast("float"))
    passes = passes.withColumn("cell_id", cell_key(F.col("map"), F.col("link"), F.col("segment"), F.col("window")))
    arrays = [F.col(f"parts.{name}").alias(name) for name in ("bin", "spent", "tenths", "gps", "timed")]
    return passes.select(local_day(F.col("window")).alias("day"), bucket(F.col("cell_id"), buckets).alias("bucket"), "cell_id", *PASS, "window", "offset", *arrays, F.size("parts").alias("n_parts"))


def explode_parts(passes: DataFrame) -> DataFrame:
    """The arrays of observations back to one row per part; arrays of unequal length are an error."""
    names = ["bin", "spent", "tenths", "gps", "timed"]
    even = F.lit(True)
    for name in names[1:]:
        even = even & (F.size(name) == F.size(names[0]))
    rest = [c for c in passes.columns if c not in names]
    return passes.select(*rest, F.inline(checked(F.arrays_zip(*names), even, "arrays are not aligned")))
