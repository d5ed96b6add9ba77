"""Observations, bins, cells, groups, masks and evaluation: the path from pieces to errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import safe_ratio, seeded

CELL = ["link", "window"]
BINS = 50


def long(x) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("long")


def total(x) -> Column:
    return F.coalesce(F.sum(x), F.lit(0)).cast("long")


def fold_bins(pieces: DataFrame, keys=(*CELL, "sample_id")) -> DataFrame:
    """One row per bin that has a piece. The time counts only if every piece of the bin is valid, else it is 0."""
    return pieces.groupBy(*keys, "bin").agg(
        F.count("*").alias("n_pieces"),
        F.count_if("valid").alias("n_valid_pieces"),
        F.when(F.min("valid"), F.sum("t")).otherwise(F.lit(0)).cast("long").alias("time_sum"),
        F.sum("ratio").cast("long").alias("ratio_sum"),
        F.min("valid").alias("bin_valid"),
    )


def compact(bins: DataFrame, keys=(*CELL, "sample_id")) -> DataFrame:
    """One row per observation: bin counts, covered metres (tenths of 10 m) and bitmaps of present and valid bins."""
    bit = F.expr("shiftleft(1L, bin)")
    rows = bins.groupBy(*keys).agg(
        F.count("*").alias("n_present"),
        F.count_if("bin_valid").alias("n_valid"),
        (F.max("bin") - F.min("bin") + 1 > F.count("*")).alias("has_internal_gap"),
        F.sum("ratio_sum").cast("long").alias("covered_m"),
        F.bit_or(bit).alias("present_bits"),
        F.coalesce(F.bit_or(F.when(F.col("bin_valid"), bit)), F.expr("0L")).alias("valid_bits"),
        F.sum("n_pieces").cast("long").alias("n_pieces"),
    )
    return rows.withColumn("usable", F.col("n_valid") > 0)


def cells(obs: DataFrame, keys=CELL) -> DataFrame:
    """K of each cell: all observations and the usable ones, with the extremes of presence and coverage."""
    return obs.groupBy(*keys).agg(
        F.count("*").alias("k_raw"),
        F.count_if("usable").alias("k_usable"),
        F.min("n_present").alias("min_present"),
        F.max("n_present").alias("max_present"),
        F.min("covered_m").alias("min_covered_m"),
        F.max("covered_m").alias("max_covered_m"),
    )


def members(obs: DataFrame, m_max: int = 16, seed=20260921, keep: int = 3) -> DataFrame:
    """Usable members in groups of at most m_max in a seeded order; a last group of fewer than `keep` is dropped.

    Groups are never evened out. k is the usable size of the whole cell, k_raw its full size.
    """
    cell = Window.partitionBy(*CELL)
    rows = obs.withColumn("k_raw", F.count("*").over(cell)).where("usable").withColumn("k", F.count("*").over(cell))
    order = seeded(seed, *[F.col(c) for c in CELL], F.col("sample_id"))
    rows = rows.withColumn("pos", F.row_number().over(cell.orderBy(order, "sample_id")) - 1)
    rows = rows.withColumn("group_index", F.expr(f"pos div {m_max}").cast("long")).withColumn("member", (F.col("pos") % m_max).cast("long"))
    rows = rows.withColumn("group_size", F.count("*").over(Window.partitionBy(*CELL, "group_index")))
    return rows.where(F.col("group_size") >= keep).drop("pos")


def groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CELL, "group_index").agg(F.max("group_size").alias("group_size"), F.max("k").alias("k"), F.max("k_raw").alias("k_raw"), F.count_if("hidden").alias("n_hidden") if "hidden" in rows.columns else F.count("*").alias("n_members"))


def hide(rows: DataFrame, epoch: int = 0) -> DataFrame:
    """Hide exactly half (rounded down) of each group, by an order seeded with group and epoch."""
    group = Window.partitionBy(*CELL, "group_index")
    order = seeded(epoch, *[F.col(c) for c in CELL], F.col("group_index"), F.col("sample_id"))
    return rows.withColumn("hidden", F.row_number().over(group.orderBy(order, "sample_id")) <= F.expr("group_size div 2"))


GROUP = [*CELL, "group_index"]


def predictions(bins: DataFrame, masked: DataFrame) -> DataFrame:
    """One row per supervised bin (valid, of a hidden member, in a group with a visible value) with its visible mean.

    The prediction is the mean of the visible members in the same bin, else that of all visible bins of the group.
    """
    keys = [*CELL, "sample_id"]
    b = bins.where("bin_valid").join(masked.select(*keys, "group_index", "group_size", "k", "hidden", "n_valid", "covered_m"), keys)
    visible = b.where("not hidden")
    same = visible.groupBy(*GROUP, "bin").agg(F.sum("time_sum").alias("s"), F.count("*").alias("support"))
    all_ = visible.groupBy(*GROUP).agg(F.sum("time_sum").alias("gs"), F.count("*").alias("gn"))
    rows = b.where("hidden").join(all_, GROUP).join(same, [*GROUP, "bin"], "left")
    rows = rows.withColumn("support", F.coalesce("support", F.lit(0)))
    value = F.when(F.col("support") > 0, F.col("s") / F.col("support")).otherwise(F.col("gs") / F.col("gn"))
    return rows.select(*GROUP, "sample_id", "bin", "group_size", "k", "n_valid", "covered_m", "ratio_sum", F.col("time_sum").alias("truth"), F.round(value, 6).alias("prediction"), "support", (F.col("support") == 0).alias("fallback"))


def metrics(pred: DataFrame, by: list[str], value: str = "prediction") -> DataFrame:
    """Bin MAE and RMSE, trajectory-total MAE and RMSE (absolute value after the sum), group-balanced MAE, counts."""
    error = F.round(F.col(value) - F.col("truth"), 6).cast("decimal(30,6)")
    traj = pred.withColumn("e", error).groupBy(*dict.fromkeys([*by, *GROUP, "sample_id"])).agg(
        F.count("*").alias("n"), F.sum(F.abs("e")).alias("ae"), F.sum(F.expr("cast(e as double) * cast(e as double)")).alias("se"), F.sum("e").alias("te"), F.count_if("fallback").alias("fb")
    )
    group = traj.groupBy(*dict.fromkeys([*by, *GROUP])).agg(
        F.sum("n").alias("n"), F.sum("ae").alias("ae"), F.sum("se").alias("se"), F.sum("fb").alias("fb"), F.count("*").alias("nt"), F.sum(F.abs("te")).alias("ate"), F.sum(F.expr("cast(te as double) * cast(te as double)")).alias("ste")
    )
    d = lambda c: F.col(c).cast("double")
    return group.groupBy(*by).agg(
        F.sum("n").cast("long").alias("n_bins"),
        F.sum("nt").cast("long").alias("n_trajectories"),
        F.count("*").alias("n_groups"),
        F.sum("fb").cast("long").alias("n_fallback"),
        F.round(F.sum("ae").cast("double") / F.sum("n"), 4).alias("bin_mae"),
        F.round(F.sqrt(F.sum("se") / F.sum("n")), 3).alias("bin_rmse"),
        F.round(F.sum("ate").cast("double") / F.sum("nt"), 4).alias("traj_mae"),
        F.round(F.sqrt(F.sum("ste") / F.sum("nt")), 3).alias("traj_rmse"),
        F.round(F.avg(d("ae") / F.col("n")), 4).alias("group_mae"),
    )


def mask_digest(pred: DataFrame, by: list[str]) -> DataFrame:
    """Identity of a set of supervised bins: order-free digest of row digests, with their count."""
    row = F.md5(F.concat_ws("|", *GROUP, "sample_id", "bin"))
    part = pred.select(*by, *[F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k}") for k in range(4)])
    return part.groupBy(*by).agg(F.count("*").alias("n_bins"), F.md5(F.concat_ws("|", *[F.sum(f"h{k}").cast("string") for k in range(4)])).alias("digest"))


def equivalent_time(bins: DataFrame) -> DataFrame:
    """Time for ten metres of each valid bin: time over covered tenths, times ten."""
    return bins.withColumn("t10", F.when(F.col("bin_valid"), safe_ratio(F.col("time_sum") * 10, F.col("ratio_sum"))))
