"""Census aggregates over cells, observations and event streams, panels, audits, geometry and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import hour_of_day, hour_slot, local_day, safe_ratio, seeded
from .core import CELL, total


def histogram(df: DataFrame, column: str, count: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias(count))


def weighted_quantiles(df: DataFrame, value: str, weight: str, quantiles: list[float], by: list[str] | None = None) -> DataFrame:
    """Smallest value whose cumulative weight reaches q of the whole; the values are pre-aggregated before they are ordered."""
    by = by or []
    h = df.groupBy(*by, value).agg(F.sum(weight).alias("w"))
    part = Window.partitionBy(*by)
    h = h.withColumn("c", F.sum("w").over(part.orderBy(value))).withColumn("all", F.sum("w").over(part))
    q = F.explode(F.array(*[F.lit(float(x)) for x in quantiles])).alias("q")
    return h.select(*by, value, "c", "all", q).where("c >= q * all").groupBy(*by, "q").agg(F.min(value).alias(value))


def m_coverage(k_hist: DataFrame, sizes: list[int]) -> DataFrame:
    """For each M: cells and observations of cells with K >= M, observations used in whole samples, samples."""
    m = F.explode(F.array(*[F.lit(x).cast("long") for x in sizes])).alias("m")
    big, k, n = F.col("k") >= F.col("m"), F.col("k"), F.col("n")
    samples = F.expr("k div m")
    return k_hist.select("k", "n", m).groupBy("m").agg(
        total(F.when(big, n)).alias("cells_ge"), total(F.when(big, n * k)).alias("obs_ge"), total(n * samples * F.col("m")).alias("used_obs"), total(n * samples).alias("samples")
    )


def band(x: Column, edges: list[int]) -> Column:
    """Lower edge of the half-open band that holds x; the last band is open."""
    out = F.lit(None).cast("long")
    for e in edges:
        out = F.when(x >= e, F.lit(e).cast("long")).otherwise(out)
    return out


def period_totals(obs: DataFrame, by: list[str]) -> DataFrame:
    """Sums and exact distinct counts of cells, links, versioned links and trajectories. Tuples count as structs, nulls included."""
    return obs.groupBy(*by).agg(
        F.count("*").alias("n_obs"),
        F.count_if("usable").alias("n_usable"),
        total("n_pieces").alias("n_pieces"),
        F.countDistinct(F.struct(*CELL)).alias("n_cells"),
        F.countDistinct("link").alias("n_links"),
        F.countDistinct(F.struct("version", "link")).alias("n_version_links"),
        F.countDistinct("traj").alias("n_traj"),
    )


def dense_windows(events: DataFrame, size: int, counts: list[Column], day_seconds: int = 86_400) -> DataFrame:
    """Counts per window of every day that occurs, zero where nothing happened. events has `window` (seconds)."""
    day = (F.floor(F.col("window") / day_seconds) * day_seconds).cast("long")
    days = events.select(day.alias("day_start")).distinct()
    grid = days.select(F.explode(F.sequence(F.col("day_start"), F.col("day_start") + day_seconds - size, F.lit(size).cast("long"))).alias("window"))
    found = events.groupBy("window").agg(*counts)
    names = [c for c in found.columns if c != "window"]
    return grid.join(found, "window", "left").select("window", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def retention(cell: DataFrame, by: list[str], m_max: int, keep: int = 3) -> DataFrame:
    """What grouping keeps: cells of `keep` or more, unusable rows, small-cell rows, dropped tails, groups."""
    k = F.col("k_usable")
    tail = k % m_max
    lost = F.when(tail < keep, tail).otherwise(0)
    return cell.groupBy(*by).agg(
        total("k_raw").alias("raw"),
        total(F.col("k_raw") - k).alias("dropped_no_valid"),
        F.count_if(k >= keep).alias("trainable_cells"),
        total(F.when(k >= keep, F.floor(k / m_max) + (tail >= keep).cast("int"))).alias("groups"),
        total(lost).alias("dropped_tail"),
        total(k - lost).alias("retained"),
    )


def link_profile(cell: DataFrame) -> DataFrame:
    """Activity of each link: sums and distinct counts over its cells."""
    return cell.groupBy("link").agg(
        total("k_raw").alias("n_obs"),
        F.count("*").alias("n_cells"),
        F.countDistinct("window").alias("n_windows"),
        F.countDistinct(local_day(F.col("window"))).alias("n_days"),
        F.countDistinct(F.expr("cast(window div 31536000 as bigint)")).alias("n_years"),
        F.max("k_raw").alias("max_k"),
    )


def active_links(profile: DataFrame, min_obs: int, min_days: int, min_windows: int, min_years: int) -> DataFrame:
    return profile.where((F.col("n_obs") >= min_obs) & (F.col("n_days") >= min_days) & (F.col("n_windows") >= min_windows) & (F.col("n_years") >= min_years))


def tier_sample(rows: DataFrame, key: str, size: str, n: int, seed) -> DataFrame:
    """n rows over four tiers of `size` (by its exact quartiles), each tier's share by seeded order; the first tiers get the rest."""
    q = rows.agg(*[F.expr(f"percentile({size}, {p})").alias(f"q{k}") for k, p in enumerate((0.25, 0.5, 0.75))])
    tier = (F.col(size) > F.col("q0")).cast("int") + (F.col(size) > F.col("q1")).cast("int") + (F.col(size) > F.col("q2")).cast("int")
    rows = rows.join(F.broadcast(q)).withColumn("tier", tier.cast("long"))  # q is one row
    quota = F.lit(n // 4) + (F.col("tier") < n % 4).cast("int")
    rank = F.row_number().over(Window.partitionBy("tier").orderBy(seeded(seed, F.col(key)), key))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= quota).drop("q0", "q1", "q2")


def detail_sample(obs: DataFrame, slots: list[int], most: int, seed, size: int = 600) -> DataFrame:
    """At most `most` observations of each cell whose window falls in the given slots of its hour, by seeded order."""
    rank = F.row_number().over(Window.partitionBy(*CELL).orderBy(seeded(seed, *[F.col(c) for c in CELL], F.col("sample_id")), "sample_id"))
    return obs.where(hour_slot(F.col("window"), size).isin(slots)).withColumn("rank", rank.cast("long")).where(F.col("rank") <= most)


def bin_quantiles(bins: DataFrame, by: list[str], value: str, quantiles=(0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact interpolated quantiles of a value by bin."""
    return bins.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), *[F.round(F.expr(f"percentile({value}, {q})"), 4).alias(f"p{round(q * 100)}") for q in quantiles])


def bin_quantiles_approx(bins: DataFrame, by: list[str], value: str, accuracy: int = 10_000) -> DataFrame:
    """Quantiles in bounded memory, for groups too large to be exact."""
    return bins.where(F.col(value).isNotNull()).groupBy(*by).agg(F.percentile_approx(value, [0.25, 0.5, 0.75, 0.9], accuracy).alias("quantiles"))


def runs(df: DataFrame, by: list[str], position: str) -> DataFrame:
    """Maximal runs of consecutive positions: (first, last, n)."""
    w = Window.partitionBy(*by).orderBy(position)
    return df.withColumn("island", F.col(position) - F.row_number().over(w)).groupBy(*by, "island").agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count("*").alias("n")).drop("island")


def gap_counts(bins: DataFrame, by: list[str]) -> DataFrame:
    """Per trajectory: present, valid and observed bins, and the gaps between its first and last present bin."""
    return bins.groupBy(*by).agg(
        F.count("*").alias("n_present"),
        F.count_if("bin_valid").alias("n_valid"),
        F.count_if(~F.col("bin_valid")).alias("n_invalid"),
        F.count_if("any_observed").alias("n_observed"),
        F.count_if(F.col("bin_valid") & ~F.col("any_observed")).alias("n_valid_unobserved"),
        (F.max("bin") - F.min("bin") + 1).cast("long").alias("span"),
        (F.max("bin") - F.min("bin") + 1 - F.count("*")).cast("long").alias("interior_missing"),
        (F.max("bin") - F.min("bin") + 1 - F.count_if("any_observed")).cast("long").alias("interior_unobserved"),
    )


def two_stage(cell: DataFrame, n_buckets: int, per_bucket: int, seed, buckets: int = 16, keep: int = 3) -> DataFrame:
    """Buckets of each day by seeded order, then cells of K >= keep in each bucket; weight is the inverse inclusion probability."""
    b = F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *CELL)), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("long")
    rows = cell.where(F.col("k_usable") >= keep).withColumn("day", F.expr("cast(window div 31536000 as bigint)")).withColumn("bucket", b)
    first = rows.select("day", "bucket").distinct()
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("day").orderBy(seeded(seed, F.col("day"), F.col("bucket")), "bucket"))).withColumn("have", F.count("*").over(Window.partitionBy("day")))
    first = first.where(F.col("r") <= n_buckets).select("day", "bucket", "have")
    part = Window.partitionBy("day", "bucket")
    rows = rows.join(first, ["day", "bucket"]).withColumn("eligible", F.count("*").over(part))
    rows = rows.withColumn("r", F.row_number().over(part.orderBy(seeded(seed, *[F.col(c) for c in CELL]), *CELL))).where(F.col("r") <= per_bucket)
    w = (F.col("have").cast("double") / F.least("have", F.lit(n_buckets))) * (F.col("eligible").cast("double") / F.least("eligible", F.lit(per_bucket)))
    return rows.select("day", "bucket", *CELL, "k_usable", F.round(w, 6).alias("weight"))


def weighted_ratio(rows: DataFrame, num: str, den: str, weight: str, by: list[str]) -> DataFrame:
    """Ratio of weighted totals; null where the weighted denominator is 0."""
    w = lambda c: F.sum((F.col(weight) * F.col(c)).cast("decimal(30,6)"))
    return rows.groupBy(*by).agg(safe_ratio(w(num), w(den)).alias("ratio"))


def geometry(dynamic: DataFrame, bad: DataFrame, static: DataFrame) -> DataFrame:
    """Length of each versioned link: a bad key has none; else its dynamic length; else the static one of the same version."""
    key = ["link", "version"]
    keys = dynamic.select(*key).union(static.select(*key)).distinct()
    rows = keys.join(bad.select(*key, F.lit(True).alias("is_bad")).distinct(), key, "left").join(dynamic.select(*key, F.col("length").alias("d")), key, "left").join(static.select(*key, F.col("length").alias("s")), key, "left")
    source = F.when(F.col("is_bad"), "bad").when(F.col("d").isNotNull(), "dynamic").when(F.col("s").isNotNull(), "static").otherwise("none")
    return rows.select(*key, source.alias("origin"), F.when(F.coalesce("is_bad", F.lit(False)), F.lit(None)).otherwise(F.coalesce("d", "s")).cast("long").alias("length"))


def coverage_band(covered: Column, length: Column) -> Column:
    share = covered.cast("double") / length
    return F.when(length.isNull() | (length <= 0), "unknown").when(share < 0.25, "<25%").when(share < 0.5, "25-50%").when(share < 0.75, "50-75%").when(share <= 1, "75-100%").otherwise(">100%")


def segment_length(length: Column, segment: Column, whole: int = 500) -> Column:
    """Length of a segment: 500 m, the last one what is left."""
    return F.least(F.lit(whole), length - whole * segment).cast("long")


def spatial_domain(bins: DataFrame, by: list[str], mode: str = "coverage", length: Column | None = None) -> DataFrame:
    """Last bin to show: of what is covered, of the geometry, or of the whole grid."""
    last = F.max("bin") + 1
    if mode == "geometry":
        last = F.least(F.ceil(F.max(length) / 10), F.lit(50))
    elif mode == "grid":
        last = F.lit(50)
    elif mode != "coverage":
        raise ValueError(f"unknown mode {mode!r}")
    return bins.groupBy(*by).agg(last.cast("long").alias("n_bins"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity; empty exactly if the tables are equal. NaN equals NaN."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def page(cell: DataFrame, offset: int, limit: int, min_k: int = 0, max_k: int | None = None, window: int | None = None) -> DataFrame:
    rows = cell.where(F.col("k_raw") >= min_k)
    rows = rows.where(F.col("k_raw") <= max_k) if max_k is not None else rows
    rows = rows.where(F.col("window") == window) if window is not None else rows
    return rows.orderBy(*CELL).offset(offset).limit(limit)


def series(events: DataFrame, by: list[str]) -> DataFrame:
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.max_by("window", "value").alias("peak"), F.min_by("window", "value").alias("trough"))


def hour_profile(cell: DataFrame, offset_hours: int = 8) -> DataFrame:
    return cell.groupBy(hour_of_day(F.col("window"), offset_hours).cast("long").alias("hour")).agg(F.count("*").alias("n_cells"), total("k_raw").alias("n_obs"))

