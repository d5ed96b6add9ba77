"""Views that the queries share, in DataFrames and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import core
from ..sources.tables import MONTH, pieces

M = 16
SEED = 20260921

SQL = {
    "p": f"""p AS (SELECT o_orderpriority AS link, o_orderstatus AS version, (epoch(o_orderdate)::BIGINT // {MONTH}) * {MONTH} AS "window",
  concat_ws('#', o_orderkey, o_orderpriority, o_custkey, (epoch(o_orderdate)::BIGINT // {MONTH}) * {MONTH}) AS sample_id, o_orderkey AS pass_id, o_custkey AS traj,
  l_quantity::INT - 1 AS bin, round(l_extendedprice * 100)::BIGINT AS t, (1 + l_linenumber % 10)::BIGINT AS ratio, l_returnflag <> 'R' AS valid, l_linestatus = 'O' AS observed,
  l_discount > 0 AS marked FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "b": """b AS (SELECT link, "window", sample_id, bin, count(*) AS n_pieces, count(*) FILTER (valid) AS n_valid_pieces, (CASE WHEN bool_and(valid) THEN sum(t) ELSE 0 END)::BIGINT AS time_sum,
  sum(ratio)::BIGINT AS ratio_sum, bool_and(valid) AS bin_valid FROM p GROUP BY ALL)""",
    "c": """c AS (SELECT link, "window", sample_id, count(*) AS n_present, count(*) FILTER (bin_valid) AS n_valid, max(bin) - min(bin) + 1 > count(*) AS has_internal_gap, sum(ratio_sum)::BIGINT AS covered_m,
  bit_or(1::BIGINT << bin) AS present_bits, coalesce(bit_or(1::BIGINT << bin) FILTER (bin_valid), 0)::BIGINT AS valid_bits, sum(n_pieces)::BIGINT AS n_pieces, count(*) FILTER (bin_valid) > 0 AS usable
  FROM b GROUP BY link, "window", sample_id)""",
    "k": """k AS (SELECT link, "window", count(*) AS k_raw, count(*) FILTER (usable) AS k_usable, min(n_present) AS min_present, max(n_present) AS max_present,
  min(covered_m) AS min_covered_m, max(covered_m) AS max_covered_m FROM c GROUP BY link, "window")""",
    "m": f"""m0 AS (SELECT *, count(*) OVER (PARTITION BY link, "window") AS k_raw FROM c),
m1 AS (SELECT *, count(*) OVER (PARTITION BY link, "window") AS k, row_number() OVER (PARTITION BY link, "window" ORDER BY md5(concat_ws('|', '{SEED}', link, "window", sample_id)), sample_id) - 1 AS pos FROM m0 WHERE usable),
m2 AS (SELECT * EXCLUDE (pos), pos // {M} AS group_index, pos % {M} AS member FROM m1),
m3 AS (SELECT *, count(*) OVER (PARTITION BY link, "window", group_index) AS group_size FROM m2),
m AS (SELECT *, row_number() OVER (PARTITION BY link, "window", group_index ORDER BY md5(concat_ws('|', '0', link, "window", group_index, sample_id)), sample_id) <= group_size // 2 AS hidden FROM m3 WHERE group_size >= 3)""",
    "r": """v AS (SELECT link, "window", sample_id, bin, ratio_sum, time_sum, group_index, group_size, k, hidden, n_valid, covered_m FROM b JOIN m USING (link, "window", sample_id) WHERE bin_valid),
vs AS (SELECT link, "window", group_index, bin, sum(time_sum)::BIGINT AS s, count(*) AS support FROM v WHERE NOT hidden GROUP BY ALL),
vg AS (SELECT link, "window", group_index, sum(time_sum)::BIGINT AS gs, count(*) AS gn FROM v WHERE NOT hidden GROUP BY ALL),
r AS (SELECT link, "window", group_index, sample_id, bin, group_size, k, n_valid, covered_m, ratio_sum, time_sum AS truth,
  round(CASE WHEN support > 0 THEN s / support ELSE gs / gn END, 6) AS prediction, coalesce(support, 0) AS support, support IS NULL AS fallback
  FROM v JOIN vg USING (link, "window", group_index) LEFT JOIN vs USING (link, "window", group_index, bin) WHERE hidden)""",
}
_ORDER = ["p", "b", "c", "k", "m", "r"]


def with_(*names: str) -> str:
    """A WITH clause of the named views."""
    return "WITH " + ",\n".join(SQL[n] for n in _ORDER if n in names) + "\n"


def metrics_sql(source: str, by: str, value: str = "prediction") -> str:
    """The metric set over `source`, grouped by the column `by`."""
    key = f'{by}, link, "window", group_index' if by != "link" else 'link, "window", group_index'
    return f""", e AS (SELECT *, round({value} - truth, 6)::DECIMAL(30,6) AS e FROM {source}),
tj AS (SELECT {key}, sample_id, count(*) AS n, sum(abs(e)) AS ae, sum(e::DOUBLE * e::DOUBLE) AS se, sum(e) AS te, count(*) FILTER (fallback) AS fb FROM e GROUP BY ALL),
gr AS (SELECT {key}, sum(n) AS n, sum(ae) AS ae, sum(se) AS se, sum(fb) AS fb, count(*) AS nt, sum(abs(te)) AS ate, sum(te::DOUBLE * te::DOUBLE) AS ste FROM tj GROUP BY ALL)
SELECT {by}, sum(n)::BIGINT AS n_bins, sum(nt)::BIGINT AS n_trajectories, count(*) AS n_groups, sum(fb)::BIGINT AS n_fallback, round(sum(ae)::DOUBLE / sum(n), 4) AS bin_mae, round(sqrt(sum(se) / sum(n)), 3) AS bin_rmse,
  round(sum(ate)::DOUBLE / sum(nt), 4) AS traj_mae, round(sqrt(sum(ste) / sum(nt)), 3) AS traj_rmse, round(avg(ae::DOUBLE / n), 4) AS group_mae FROM gr GROUP BY {by}"""


def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.fold_bins(pieces(spark, sf_dir))


def compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.compact(bins(spark, sf_dir))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.cells(compact(spark, sf_dir))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return core.hide(core.members(compact(spark, sf_dir), M, SEED))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = bins(spark, sf_dir)
    return core.predictions(folded, core.hide(core.members(core.compact(folded), M, SEED)))
