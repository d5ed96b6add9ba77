"""The registered queries and, beside each, its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import delta_bucket, epoch, hour_slot, safe_ratio, window_start
from ..operators import census, core
from ..operators.core import CELL, GROUP, long, total
from ..sources.publish import nested_export
from ..sources.tables import pieces, table
from . import base
from .base import with_

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Bins, observations, cells


@query(with_("p", "b") + "SELECT * FROM b")
def fold_bins(spark, sf):
    return base.bins(spark, sf)


@query(with_("p", "b", "c", "m", "r") + base.metrics_sql("r", "link"))
def visible_mean_baseline(spark, sf):
    """Pieces, bins, groups, masks, visible means and their errors by link."""
    return core.metrics(base.predicted(spark, sf), ["link"])


@query(with_("p") + """SELECT link, "window", sample_id, count(*) AS n_pieces, min(t) AS first_t, max(t) AS last_t, count(*) FILTER (valid) AS n_valid_pieces,
  array_to_string(list(bin ORDER BY bin, t, ratio), ',') AS bin_pos, array_to_string(list(t ORDER BY bin, t, ratio), ',') AS t_diff FROM p WHERE marked GROUP BY link, "window", sample_id""")
def observations(spark, sf):
    """Marked pieces of each sample in order, as aligned arrays (joined as text here)."""
    p = pieces(spark, sf).where("marked")
    o = p.groupBy(*CELL, "sample_id").agg(F.array_sort(F.collect_list(F.struct("bin", "t", "ratio"))).alias("z"), F.count("*").alias("n_pieces"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count_if("valid").alias("n_valid_pieces"))
    text = lambda c: F.array_join(F.transform("z", lambda x: x[c].cast("string")), ",")
    return o.select(*CELL, "sample_id", "n_pieces", "first_t", "last_t", "n_valid_pieces", text("bin").alias("bin_pos"), text("t").alias("t_diff"))


@query(with_("p", "b", "c", "k") + "SELECT * FROM k")
def cells_k(spark, sf):
    return base.cells(spark, sf)


@query(with_("p", "b", "c") + "SELECT *, bit_count(present_bits & ~valid_bits)::BIGINT AS n_invalid FROM c")
def compact_rows(spark, sf):
    return base.compact(spark, sf).withColumn("n_invalid", F.expr("cast(bit_count(present_bits & ~valid_bits) as bigint)"))


@query(with_("p", "b", "c") + "SELECT link, has_internal_gap, count(*) AS n FROM c GROUP BY ALL")
def internal_gap(spark, sf):
    return base.compact(spark, sf).groupBy("link", "has_internal_gap").agg(F.count("*").alias("n"))


@query(with_("p") + """, q AS (SELECT link, t, ratio, valid, t::DOUBLE / 100 AS s FROM p)
SELECT link, floor(s / 600)::BIGINT * 600 AS bucket, count(*) AS n, count(*) FILTER (valid) AS n_known, max(least(floor((s - floor(s / 600) * 600) / 30), 19))::BIGINT AS max_slot FROM q GROUP BY 1, 2""")
def tumbling_offsets(spark, sf):
    """600-second windows of a measure, with the 30-second bucket of the offset."""
    s = (F.col("t") / 100.0).alias("s")
    p = pieces(spark, sf).select("link", s, "valid").withColumn("bucket", window_start(F.col("s")))
    return p.groupBy("link", "bucket").agg(F.count("*").alias("n"), F.count_if("valid").alias("n_known"), F.max(delta_bucket(F.col("s") - F.col("bucket"))).cast("long").alias("max_slot"))


# Census


@query(with_("p", "b", "c", "k") + "SELECT k_raw AS k, count(*) AS n FROM k GROUP BY 1")
def k_histogram(spark, sf):
    return census.histogram(base.cells(spark, sf).select(F.col("k_raw").alias("k")), "k")


@query(with_("p", "b", "c", "k") + ", q AS (SELECT unnest([0.25, 0.5, 0.75, 0.9, 0.99])::DOUBLE AS q), h AS (SELECT k_raw AS k, count(*) AS w FROM k GROUP BY 1), s AS (SELECT k, sum(w) OVER (ORDER BY k) AS c, sum(w) OVER () AS a FROM h) SELECT q, min(k) AS k FROM s, q WHERE c >= q * a GROUP BY q")
def k_percentiles(spark, sf):
    k = base.cells(spark, sf).select(F.col("k_raw").alias("k"), F.lit(1).alias("one"))
    return census.weighted_quantiles(k, "k", "one", [0.25, 0.5, 0.75, 0.9, 0.99])


@query(with_("p", "b", "c", "k") + """, h AS (SELECT k_raw AS k, count(*) AS n FROM k GROUP BY 1), s AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64])::BIGINT AS m)
SELECT m, coalesce(sum(n) FILTER (k >= m), 0)::BIGINT AS cells_ge, coalesce(sum(n * k) FILTER (k >= m), 0)::BIGINT AS obs_ge, sum(n * (k // m) * m)::BIGINT AS used_obs, sum(n * (k // m))::BIGINT AS samples FROM h, s GROUP BY m""")
def m_coverage(spark, sf):
    h = census.histogram(base.cells(spark, sf).select(F.col("k_raw").alias("k")), "k")
    return census.m_coverage(h, [1, 2, 4, 8, 16, 32, 64])


@query(with_("p", "b", "c", "k") + 'SELECT "window", count(*) AS n_cells, sum(k_raw)::BIGINT AS n_obs, max(k_raw) AS max_k, count(*) FILTER (k_raw >= 4) AS cells_ge_4, count(*) FILTER (k_raw >= 16) AS cells_ge_16 FROM k GROUP BY 1')
def per_window_shape(spark, sf):
    return base.cells(spark, sf).groupBy("window").agg(F.count("*").alias("n_cells"), total("k_raw").alias("n_obs"), F.max("k_raw").alias("max_k"), F.count_if(F.col("k_raw") >= 4).alias("cells_ge_4"), F.count_if(F.col("k_raw") >= 16).alias("cells_ge_16"))


_EDGES = [1, 2, 3, 5, 9, 17, 33, 65, 129, 257, 513, 1025, 2049]


@query(with_("p", "b", "c", "k") + f", e AS (SELECT unnest({_EDGES})::BIGINT AS e) SELECT low, count(*) AS n_cells, sum(k_raw)::BIGINT AS n_obs FROM (SELECT k_raw, (SELECT max(e) FROM e WHERE e <= k_raw) AS low FROM k) GROUP BY low")
def k_buckets(spark, sf):
    return base.cells(spark, sf).groupBy(census.band(F.col("k_raw"), _EDGES).alias("low")).agg(F.count("*").alias("n_cells"), total("k_raw").alias("n_obs"))


def _observed(spark, sf):
    p = pieces(spark, sf)
    ids = p.groupBy(*CELL, "sample_id").agg(F.max("version").alias("version"), F.max("traj").alias("traj"))
    return core.compact(core.fold_bins(p)).join(ids, [*CELL, "sample_id"])


_IDS = ', i AS (SELECT link, "window", sample_id, max(version) AS version, max(traj) AS traj FROM p GROUP BY ALL), o AS (SELECT * FROM c JOIN i USING (link, "window", sample_id))'
_TOTALS = 'count(*) AS n_obs, count(*) FILTER (usable) AS n_usable, sum(n_pieces)::BIGINT AS n_pieces, count(DISTINCT (link, "window")) AS n_cells, count(DISTINCT link) AS n_links, count(DISTINCT (version, link)) AS n_version_links, count(DISTINCT traj) AS n_traj'


@query(with_("p", "b", "c") + _IDS + f' SELECT "window", {_TOTALS} FROM o GROUP BY "window"')
def daily_totals(spark, sf):
    return census.period_totals(_observed(spark, sf), ["window"])


@query(with_("p", "b", "c") + _IDS + f" SELECT {_TOTALS} FROM o")
def period_totals(spark, sf):
    return census.period_totals(_observed(spark, sf), [])


@query("""WITH e AS (SELECT (floor(epoch(ts) / 600) * 600)::BIGINT AS "window", user_id, event_type FROM events),
d AS (SELECT DISTINCT "window" // 86400 * 86400 AS d FROM e), g AS (SELECT unnest(range(d, d + 86400, 600)) AS "window" FROM d)
SELECT g."window", count(e."window") AS n_events, count(DISTINCT user_id) AS n_users, count(DISTINCT event_type) AS n_types FROM g LEFT JOIN e ON e."window" = g."window" GROUP BY 1""")
def window_series_dense(spark, sf):
    """All 144 windows of every day, empty ones with zeros."""
    e = table(spark, sf, "events", "ts", "user_id", "event_type").withColumn("window", window_start(epoch(F.col("ts"))))
    return census.dense_windows(e, 600, [F.count("*").alias("n_events"), F.countDistinct("user_id").alias("n_users"), F.countDistinct("event_type").alias("n_types")])


@query(with_("p", "b", "c", "k") + "SELECT kind, k, count(*) AS n FROM (SELECT 'raw' AS kind, k_raw AS k FROM k UNION ALL SELECT 'usable', k_usable FROM k) GROUP BY ALL")
def k_distribution(spark, sf):
    k = base.cells(spark, sf)
    both = k.select(F.lit("raw").alias("kind"), F.col("k_raw").alias("k")).unionByName(k.select(F.lit("usable").alias("kind"), F.col("k_usable").alias("k")))
    return both.groupBy("kind", "k").agg(F.count("*").alias("n"))


@query(with_("p", "b", "c", "k") + """SELECT "window", sum(k_raw)::BIGINT AS raw, sum(k_raw - k_usable)::BIGINT AS dropped_no_valid, count(*) FILTER (k_usable >= 3) AS trainable_cells,
  coalesce(sum(k_usable // 16 + CASE WHEN k_usable % 16 >= 3 THEN 1 ELSE 0 END) FILTER (k_usable >= 3), 0)::BIGINT AS groups, sum(CASE WHEN k_usable % 16 < 3 THEN k_usable % 16 ELSE 0 END)::BIGINT AS dropped_tail,
  sum(k_usable - CASE WHEN k_usable % 16 < 3 THEN k_usable % 16 ELSE 0 END)::BIGINT AS retained FROM k GROUP BY "window" """)
def training_retention(spark, sf):
    return census.retention(base.cells(spark, sf), ["window"], base.M)


@query(with_("p", "b", "c") + "SELECT n_present, n_valid, count(*) AS n FROM c GROUP BY ALL")
def coverage_bins(spark, sf):
    return base.compact(spark, sf).groupBy("n_present", "n_valid").agg(F.count("*").alias("n"))


@query(with_("p", "b", "c") + ", x AS (SELECT link, min(bin)::BIGINT AS min_bin, max(bin)::BIGINT AS max_bin FROM b GROUP BY link) SELECT link, min_bin, max_bin, max(covered_m) AS max_covered_m, sum(n_present)::BIGINT AS n_bins FROM x JOIN c USING (link) GROUP BY ALL")
def observed_links(spark, sf):
    """Extent of each link from compact rows: the bitmaps' lowest and highest bits."""
    c = base.compact(spark, sf)
    return c.groupBy("link").agg(
        F.min(F.expr("cast(bit_count((present_bits & -present_bits) - 1) as bigint)")).alias("min_bin"),
        F.max(F.expr("cast(length(bin(present_bits)) - 1 as bigint)")).alias("max_bin"),
        F.max("covered_m").alias("max_covered_m"),
        total("n_present").alias("n_bins"),
    )


@query(with_("p", "b", "c", "k") + "SELECT hour, count(*) AS n_cells, sum(k_raw)::BIGINT AS n_obs FROM (SELECT (\"window\" // 3600 + 8) % 24 AS hour, k_raw FROM k) GROUP BY hour")
def hour_profile(spark, sf):
    return census.hour_profile(base.cells(spark, sf))


@query("""WITH e AS (SELECT event_type, (floor(epoch(ts) / 600) * 600)::BIGINT AS "window", value FROM events), h AS (SELECT event_type, "window", count(*) AS value FROM e GROUP BY ALL),
x AS (SELECT event_type, count(*) AS n, max(value) AS hi, min(value) AS lo FROM h GROUP BY event_type)
SELECT event_type, n, hi, lo, (SELECT min("window") FROM h WHERE h.event_type = x.event_type AND value = hi) AS peak, (SELECT min("window") FROM h WHERE h.event_type = x.event_type AND value = lo) AS trough FROM x""")
def peak_trough(spark, sf):
    """Busiest and quietest window of each event type; the earliest among equals."""
    e = table(spark, sf, "events", "ts", "event_type").withColumn("window", window_start(epoch(F.col("ts"))))
    h = e.groupBy("event_type", "window").agg(F.count("*").alias("value"))
    return h.groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("hi"), F.min("value").alias("lo"), F.max_by("window", F.struct("value", -F.col("window"))).alias("peak"), F.min_by("window", F.struct("value", "window")).alias("trough"))


# Groups and masks


@query(with_("p", "b", "c", "m") + 'SELECT link, "window", group_index, max(group_size) AS group_size, max(k) AS k, max(k_raw) AS k_raw, count(*) FILTER (hidden) AS n_hidden FROM m GROUP BY link, "window", group_index')
def group_specs(spark, sf):
    return core.groups(base.masked(spark, sf))


@query(with_("p", "b", "c", "m") + 'SELECT link, "window", group_index, member, sample_id, group_size, k, k_raw FROM m')
def group_members(spark, sf):
    return core.members(base.compact(spark, sf), base.M, base.SEED).select(*GROUP, "member", "sample_id", "group_size", "k", "k_raw")


@query(with_("p", "b", "c", "m") + 'SELECT link, "window", group_index, sample_id, hidden FROM m')
def mask_hidden(spark, sf):
    return base.masked(spark, sf).select(*GROUP, "sample_id", "hidden")


@query(with_("p", "b", "c", "m") + """, u AS (SELECT link, "window", group_index, bit_or(valid_bits) FILTER (NOT hidden) AS seen FROM m GROUP BY ALL)
SELECT link, count(*) AS n_hidden, sum(bit_count(valid_bits))::BIGINT AS supervised_bins, sum(bit_count(valid_bits & seen))::BIGINT AS supported_bins, sum(bit_count(valid_bits & ~seen))::BIGINT AS fallback_bins
FROM m JOIN u USING (link, "window", group_index) WHERE hidden GROUP BY link""")
def mask_reference(spark, sf):
    """Supervised and supported bins from the bitmaps alone."""
    m = base.masked(spark, sf)
    seen = m.where("not hidden").groupBy(*GROUP).agg(F.bit_or("valid_bits").alias("seen"))
    bits = lambda e: F.sum(F.expr(f"bit_count({e})")).cast("long")
    return m.where("hidden").join(seen, GROUP).groupBy("link").agg(F.count("*").alias("n_hidden"), bits("valid_bits").alias("supervised_bins"), bits("valid_bits & seen").alias("supported_bins"), bits("valid_bits & ~seen").alias("fallback_bins"))


# Evaluation


@query(with_("p", "b", "c", "m", "r") + base.metrics_sql('(SELECT \'all\' AS scope, * FROM r)', "scope"))
def eval_metrics(spark, sf):
    return core.metrics(base.predicted(spark, sf).withColumn("scope", F.lit("all")), ["scope"])


_STRATA = "CASE WHEN k < 20 THEN 'k<20' WHEN k < 40 THEN 'k20-39' ELSE 'k40+' END"
_LENGTH = "CASE WHEN n_valid <= 1 THEN 'len1' WHEN n_valid <= 3 THEN 'len2-3' ELSE 'len4+' END"
_SUPPORT = "CASE WHEN support = 0 THEN 'sup0' WHEN support < 3 THEN 'sup1-2' ELSE 'sup3+' END"
_RATIO = "CASE WHEN ratio_sum >= 10 THEN 'full' ELSE 'partial' END"


@query(with_("p", "b", "c", "m", "r") + base.metrics_sql(f"(SELECT unnest([{_STRATA}, {_LENGTH}, {_SUPPORT}, {_RATIO}]) AS stratum, * FROM r)", "stratum"))
def eval_strata(spark, sf):
    """The metric set by cell size, valid length, support and bin ratio: one pass, each row in four strata."""
    p = base.predicted(spark, sf)
    return core.metrics(p.withColumn("stratum", F.explode(F.array(*[F.expr(x) for x in (_STRATA, _LENGTH, _SUPPORT, _RATIO)]))), ["stratum"])


@query(with_("p", "b", "c", "m", "r") + "SELECT * FROM r")
def eval_predictions(spark, sf):
    return base.predicted(spark, sf)


@query(with_("p", "b", "c", "m", "r") + """, w AS (SELECT bin, round(sum(time_sum)::BIGINT / count(*), 6) AS model FROM v WHERE NOT hidden GROUP BY bin),
x AS (SELECT link, round(prediction - truth, 6)::DECIMAL(30,6) AS e, round(model - truth, 6)::DECIMAL(30,6) AS f FROM r JOIN w USING (bin))
SELECT link, count(*) AS n_bins, round(sum(abs(e))::DOUBLE / count(*), 4) AS baseline_mae, round(sum(abs(f))::DOUBLE / count(*), 4) AS model_mae, round(100 * (1 - sum(abs(f))::DOUBLE / sum(abs(e))::DOUBLE), 4) AS improvement_pct FROM x GROUP BY link""")
def model_vs_baseline(spark, sf):
    """A model's predictions (here the corpus-wide visible bin mean) paired with the baseline on the same bins."""
    folded = base.bins(spark, sf)
    m = core.hide(core.members(core.compact(folded), base.M, base.SEED))
    seen = folded.where("bin_valid").join(m.where("not hidden").select(*CELL, "sample_id"), [*CELL, "sample_id"])
    model = seen.groupBy("bin").agg(F.round(F.sum("time_sum") / F.count("*"), 6).alias("model"))
    e = lambda c: F.abs(F.round(F.col(c) - F.col("truth"), 6).cast("decimal(30,6)"))
    x = core.predictions(folded, m).join(model, "bin").groupBy("link").agg(F.count("*").alias("n_bins"), F.sum(e("prediction")).cast("double").alias("b"), F.sum(e("model")).cast("double").alias("m"))
    return x.select("link", "n_bins", F.round(F.col("b") / F.col("n_bins"), 4).alias("baseline_mae"), F.round(F.col("m") / F.col("n_bins"), 4).alias("model_mae"), F.round(100 * (1 - F.col("m") / F.col("b")), 4).alias("improvement_pct"))


def _digest_sql() -> str:
    h = [f"sum(('0x' || substring(h, {1 + 8 * k}, 8))::BIGINT)::BIGINT" for k in range(4)]
    return f", x AS (SELECT link, md5(concat_ws('|', link, \"window\", group_index, sample_id, bin)) AS h FROM r) SELECT link, count(*) AS n_bins, md5(concat_ws('|', {', '.join(h)})) AS digest FROM x GROUP BY link"


@query(with_("p", "b", "c", "m", "r") + _digest_sql())
def mask_identity(spark, sf):
    return core.mask_digest(base.predicted(spark, sf), ["link"])


# Representative panel


@query(with_("p", "b", "c", "k") + "SELECT link, sum(k_raw)::BIGINT AS n_obs, count(*) AS n_cells, count(DISTINCT \"window\") AS n_windows, count(DISTINCT \"window\" // 86400) AS n_days, count(DISTINCT \"window\" // 31536000) AS n_years, max(k_raw) AS max_k FROM k GROUP BY link")
def link_profile(spark, sf):
    return census.link_profile(base.cells(spark, sf))


@query(with_("p", "b", "c", "k") + """, x AS (SELECT link, sum(k_raw)::BIGINT AS n_obs, count(DISTINCT "window") AS n_windows FROM k GROUP BY link),
y AS (SELECT traj, count(*) AS n_obs FROM (SELECT DISTINCT traj, sample_id FROM p) GROUP BY traj HAVING count(*) >= 2),
q AS (SELECT quantile_cont(n_obs, 0.25) AS a, quantile_cont(n_obs, 0.5) AS b, quantile_cont(n_obs, 0.75) AS c FROM y),
z AS (SELECT traj, n_obs, (n_obs > a)::INT + (n_obs > b)::INT + (n_obs > c)::INT AS tier FROM y, q),
s AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY md5(concat_ws('|', '20260911', traj)), traj) AS rank FROM z)
SELECT traj, n_obs, tier::BIGINT AS tier, rank FROM s WHERE rank <= 48 // 4 + CASE WHEN tier < 48 % 4 THEN 1 ELSE 0 END""")
def link_panel(spark, sf):
    """Entities with enough activity, 48 of them over four activity tiers (trajectories stand in for links)."""
    y = pieces(spark, sf).select("traj", "sample_id").distinct().groupBy("traj").agg(F.count("*").alias("n_obs")).where("n_obs >= 2")
    return census.tier_sample(y, "traj", "n_obs", 48, 20260911)


@query(with_("p", "b", "c", "k") + "SELECT link, \"window\" // 31536000 AS year, count(*) AS n_cells, sum(k_raw)::BIGINT AS n_obs, round(count(*) FILTER (k_usable >= 3)::DOUBLE / count(*), 6) AS share_k3, array_to_string(list(DISTINCT k_usable ORDER BY k_usable), ',') AS ks FROM k GROUP BY ALL")
def link_day_profile(spark, sf):
    k = base.cells(spark, sf).withColumn("year", F.expr("window div 31536000").cast("long"))
    return k.groupBy("link", "year").agg(F.count("*").alias("n_cells"), total("k_raw").alias("n_obs"), safe_ratio(F.count_if(F.col("k_usable") >= 3), F.count("*")).alias("share_k3"), F.array_join(F.sort_array(F.collect_set("k_usable")).cast("array<string>"), ",").alias("ks"))


@query(with_("p", "b") + ", x AS (SELECT link, bin, round(time_sum * 10 / nullif(ratio_sum, 0), 6) AS t10 FROM b WHERE bin_valid) SELECT link, bin, count(*) AS n, round(quantile_cont(t10, 0.25), 4) AS p25, round(quantile_cont(t10, 0.5), 4) AS p50, round(quantile_cont(t10, 0.75), 4) AS p75, round(quantile_cont(t10, 0.9), 4) AS p90 FROM x GROUP BY ALL")
def bin_quantiles(spark, sf):
    return census.bin_quantiles(core.equivalent_time(base.bins(spark, sf)), ["link", "bin"], "t10")


@query(with_("p", "b", "c") + """, x AS (SELECT *, row_number() OVER (PARTITION BY link, "window" ORDER BY md5(concat_ws('|', '20260911', link, "window", sample_id)), sample_id) AS rank FROM c WHERE ("window" % 3600) // 600 IN (0, 1, 4))
SELECT link, "window", sample_id, n_present, rank FROM x WHERE rank <= 8""")
def detail_sample(spark, sf):
    return census.detail_sample(base.compact(spark, sf), [0, 1, 4], 8, 20260911).select(*CELL, "sample_id", "n_present", "rank")


@query("SELECT ((floor(epoch(ts))::BIGINT % 3600) // 600)::INT AS slot, count(*) AS n, sum((props->>'k')::BIGINT)::BIGINT AS k_sum FROM events WHERE (floor(epoch(ts))::BIGINT % 3600) // 600 IN (1, 4) GROUP BY 1")
def slot_filter(spark, sf):
    """Slots of the hour, with a value out of JSON text."""
    e = table(spark, sf, "events", "ts", "props").withColumn("slot", hour_slot(window_start(epoch(F.col("ts")))))
    return e.where(F.col("slot").isin(1, 4)).groupBy("slot").agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


# Audits


@query(with_("p") + """SELECT link, count(*) AS n, count(*) FILTER (bin NOT BETWEEN 0 AND 49) AS bad_bin, count(*) FILTER (ratio NOT BETWEEN 1 AND 10) AS bad_ratio, count(*) FILTER (t < 0) AS bad_time,
  count(*) FILTER (sample_id IS NULL) AS null_id, count(*) FILTER (len(string_split(sample_id, '#')) <> 4) AS bad_id, count(*) FILTER (split_part(sample_id, '#', 2) <> link) AS wrong_link, count(*) FILTER (NOT valid) AS n_invalid,
  round(count(*) FILTER (valid)::DOUBLE / count(*), 6) AS valid_share, count(*) FILTER (bin NOT BETWEEN 0 AND 49 OR ratio NOT BETWEEN 1 AND 10 OR t < 0) = 0 AS passed FROM p GROUP BY link""")
def qc_observations(spark, sf):
    p = pieces(spark, sf)
    bin_, ratio, time = ~F.col("bin").between(0, 49), ~F.col("ratio").between(1, 10), F.col("t") < 0
    n = F.count_if
    return p.groupBy("link").agg(
        F.count("*").alias("n"), n(bin_).alias("bad_bin"), n(ratio).alias("bad_ratio"), n(time).alias("bad_time"), n(F.col("sample_id").isNull()).alias("null_id"), n(F.size(F.split("sample_id", "#")) != 4).alias("bad_id"),
        n(F.split_part("sample_id", F.lit("#"), F.lit(2)) != F.col("link")).alias("wrong_link"), n(~F.col("valid")).alias("n_invalid"), safe_ratio(n("valid"), F.count("*")).alias("valid_share"), (n(bin_ | ratio | time) == 0).alias("passed"),
    )


@query(with_("p", "b", "c") + """SELECT count(*) AS n, count(*) - count(DISTINCT (link, "window", sample_id)) AS duplicates, count(*) FILTER (sample_id IS NULL OR link IS NULL) AS nulls,
  count(*) FILTER (len(string_split(sample_id, '#')) <> 4 OR NOT regexp_full_match(sample_id, '[0-9]+#[^#]+#[0-9]+#[0-9]+')) AS malformed FROM c""")
def identity_audit(spark, sf):
    c = base.compact(spark, sf)
    bad = (F.size(F.split("sample_id", "#")) != 4) | ~F.col("sample_id").rlike("^[0-9]+#[^#]+#[0-9]+#[0-9]+$")
    return c.agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct(F.struct(*CELL, "sample_id"))).alias("duplicates"), F.count_if(F.col("sample_id").isNull() | F.col("link").isNull()).alias("nulls"), F.count_if(bad).alias("malformed"))


@query(with_("p") + """, s AS (SELECT sample_id, link, bool_or(bin = 0) AS a, bool_or(bin = 49) AS z, bool_or(bin = 0 AND valid) AS av, bool_or(bin = 49 AND valid) AS zv, bool_or(NOT valid) AS bad, count(DISTINCT bin) AS n, max(bin) - min(bin) + 1 AS span FROM p GROUP BY ALL)
SELECT link, count(*) AS n_samples, count(*) FILTER (a) AS at_start, count(*) FILTER (z) AS at_end, count(*) FILTER (a AND z) AS at_both, count(*) FILTER (av) AS valid_start, count(*) FILTER (zv) AS valid_end, count(*) FILTER (bad) AS any_invalid,
  count(*) FILTER (n = span) AS contiguous, sum(span)::BIGINT AS total_span, sum(n)::BIGINT AS total_bins, min(sample_id) FILTER (a AND z) AS example FROM s GROUP BY link""")
def boundary_audit(spark, sf):
    a, z = F.col("bin") == 0, F.col("bin") == 49
    s = pieces(spark, sf).groupBy("sample_id", "link").agg(
        F.max(a).alias("a"), F.max(z).alias("z"), F.max(a & F.col("valid")).alias("av"), F.max(z & F.col("valid")).alias("zv"), F.max(~F.col("valid")).alias("bad"), F.countDistinct("bin").alias("n"), (F.max("bin") - F.min("bin") + 1).alias("span")
    )
    n = F.count_if
    return s.groupBy("link").agg(
        F.count("*").alias("n_samples"), n("a").alias("at_start"), n("z").alias("at_end"), n(F.col("a") & F.col("z")).alias("at_both"), n("av").alias("valid_start"), n("zv").alias("valid_end"), n("bad").alias("any_invalid"),
        n(F.col("n") == F.col("span")).alias("contiguous"), total("span").alias("total_span"), total("n").alias("total_bins"), F.min(F.when(F.col("a") & F.col("z"), F.col("sample_id"))).alias("example"),
    )


@query(with_("p") + """, s AS (SELECT sample_id, max(bin) - min(bin) + 1 = count(DISTINCT bin) AS contiguous, bool_and(observed = valid) AS observed_ok, count(*) AS n, count(DISTINCT bin) AS bins, sum(t)::BIGINT AS t FROM p GROUP BY sample_id),
q AS (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS whole FROM orders), x AS (SELECT s.*, s.t = q.whole AS closed FROM s JOIN q ON split_part(s.sample_id, '#', 1)::BIGINT = q.o_orderkey)
SELECT contiguous, observed_ok, closed, count(*) AS n_samples, sum(n)::BIGINT AS n_pieces, sum(bins)::BIGINT AS n_bins FROM x GROUP BY ALL""")
def package_contract(spark, sf):
    """Closure of the sum against the pass total, observation flags and contiguity, per sample."""
    s = pieces(spark, sf).groupBy("sample_id", "pass_id").agg(
        (F.max("bin") - F.min("bin") + 1 == F.countDistinct("bin")).alias("contiguous"), F.min(F.col("observed") == F.col("valid")).alias("observed_ok"), F.count("*").alias("n"), F.countDistinct("bin").alias("bins"), F.sum("t").alias("t")
    )
    q = table(spark, sf, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias("pass_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("whole"))
    x = s.join(q, "pass_id").withColumn("closed", F.col("t") == F.col("whole"))
    return x.groupBy("contiguous", "observed_ok", "closed").agg(F.count("*").alias("n_samples"), total("n").alias("n_pieces"), total("bins").alias("n_bins"))


@query(with_("p", "b", "c", "k") + """, a AS (SELECT link, k_raw AS k FROM k), z AS (SELECT link, k_usable AS k FROM k)
SELECT side, link, k, count(*) AS n FROM (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM z) UNION ALL SELECT 'right', * FROM (SELECT * FROM z EXCEPT ALL SELECT * FROM a)) GROUP BY ALL""")
def symmetric_diff(spark, sf):
    k = base.cells(spark, sf)
    d = census.symmetric_difference(k.select("link", F.col("k_raw").alias("k")), k.select("link", F.col("k_usable").alias("k")))
    return d.groupBy("side", "link", "k").agg(F.count("*").alias("n"))


@query(with_("p", "b", "c", "k", "m") + """SELECT (SELECT count(*) FROM c WHERE n_valid > n_present) AS valid_over_present, (SELECT count(*) FROM c WHERE bit_count(present_bits) <> n_present) AS bits_differ, (SELECT count(*) FROM k WHERE k_usable > k_raw) AS usable_over_raw,
  (SELECT sum(k_raw) FROM k)::BIGINT - (SELECT count(*) FROM c) AS k_sum_gap, (SELECT count(*) FROM c WHERE usable) - (SELECT count(*) FROM m) AS dropped_tails, (SELECT count(*) FROM m WHERE group_size > 16) AS oversized""")
def integrity(spark, sf):
    """Counters that tie reductions to their base tables."""
    c = base.compact(spark, sf)
    k, m = core.cells(c), core.members(c, base.M, base.SEED)
    a = c.agg(F.count_if(F.col("n_valid") > F.col("n_present")).alias("valid_over_present"), F.count_if(F.expr("bit_count(present_bits) <> n_present")).alias("bits_differ"), F.count("*").alias("n"), F.count_if("usable").alias("u"))
    b = k.agg(F.count_if(F.col("k_usable") > F.col("k_raw")).alias("usable_over_raw"), total("k_raw").alias("s"))
    g = m.agg(F.count("*").alias("g"), F.count_if(F.col("group_size") > base.M).alias("oversized"))
    one = lambda d: d.withColumn("_", F.lit(1))
    return one(a).join(one(b), "_").join(one(g), "_").select("valid_over_present", "bits_differ", "usable_over_raw", (F.col("s") - F.col("n")).alias("k_sum_gap"), (F.col("u") - F.col("g")).alias("dropped_tails"), "oversized")


# Geometry


def _geometry(spark, sf):
    p = table(spark, sf, "part", "p_partkey", "p_brand", "p_type", "p_size")
    key = [F.col("p_partkey").cast("string").alias("link"), F.col("p_brand").alias("version")]
    dynamic = p.where("p_partkey % 3 <> 0").select(*key, (F.col("p_size") * 30).cast("long").alias("length"))
    static = p.where("p_partkey % 5 <> 0").select(*key, (F.col("p_size") * 31).cast("long").alias("length"))
    bad = p.where("p_size % 7 = 0").select(*key)
    return census.geometry(dynamic, bad, static)


_GEO = """WITH g0 AS (SELECT p_partkey::VARCHAR AS link, p_brand AS version, p_partkey, p_size FROM part),
d AS (SELECT link, version, p_size::BIGINT * 30 AS l FROM g0 WHERE p_partkey % 3 <> 0), s AS (SELECT link, version, p_size::BIGINT * 31 AS l FROM g0 WHERE p_partkey % 5 <> 0), x AS (SELECT DISTINCT link, version, true AS bad FROM g0 WHERE p_size % 7 = 0),
g AS (SELECT link, version, CASE WHEN bad THEN 'bad' WHEN d.l IS NOT NULL THEN 'dynamic' WHEN s.l IS NOT NULL THEN 'static' ELSE 'none' END AS origin, CASE WHEN bad THEN NULL ELSE coalesce(d.l, s.l) END AS length
  FROM (SELECT link, version FROM d UNION SELECT link, version FROM s) LEFT JOIN x USING (link, version) LEFT JOIN d USING (link, version) LEFT JOIN s USING (link, version))
"""


@query(_GEO + "SELECT * FROM g")
def geometry_resolve(spark, sf):
    return _geometry(spark, sf)


@query(_GEO + "SELECT origin, count(*) AS n, count(length) AS n_known, min(length) AS min_m, median(length) AS median_m, round(avg(length), 4) AS mean_m, max(length) AS max_m FROM g GROUP BY origin")
def geometry_sources(spark, sf):
    return _geometry(spark, sf).groupBy("origin").agg(F.count("*").alias("n"), F.count("length").alias("n_known"), F.min("length").alias("min_m"), F.median("length").alias("median_m"), F.round(F.avg("length"), 4).alias("mean_m"), F.max("length").alias("max_m"))


_COVER = ", u AS (SELECT l_partkey::VARCHAR AS link, sum(l_quantity)::BIGINT AS covered FROM lineitem GROUP BY 1)"


def _covered(spark, sf):
    u = table(spark, sf, "lineitem", "l_partkey", "l_quantity").groupBy(F.col("l_partkey").cast("string").alias("link")).agg(F.sum("l_quantity").cast("long").alias("covered"))
    return u.join(_geometry(spark, sf), "link", "left")


@query(_GEO + _COVER + """ SELECT band, count(*) AS n, sum(covered)::BIGINT AS covered FROM (SELECT covered, CASE WHEN length IS NULL OR length <= 0 THEN 'unknown' WHEN covered / length < 0.25 THEN '<25%' WHEN covered / length < 0.5 THEN '25-50%'
  WHEN covered / length < 0.75 THEN '50-75%' WHEN covered / length <= 1 THEN '75-100%' ELSE '>100%' END AS band FROM u LEFT JOIN g USING (link)) GROUP BY band""")
def coverage_bands(spark, sf):
    x = _covered(spark, sf)
    return x.groupBy(census.coverage_band(F.col("covered"), F.col("length")).alias("band")).agg(F.count("*").alias("n"), total("covered").alias("covered"))


@query(_GEO + ", t AS (SELECT link, version, length, unnest(range(0, (length + 499) // 500)) AS seg FROM g WHERE length > 0) SELECT CASE WHEN seg = (length - 1) // 500 AND length % 500 <> 0 THEN 'last' ELSE 'whole' END AS kind, least(500, length - 500 * seg) AS seg_m, count(*) AS n FROM t GROUP BY ALL")
def segment_types(spark, sf):
    g = _geometry(spark, sf).where("length > 0").select("length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(length + 499) div 500 - 1"))).alias("seg"))
    kind = F.when((F.col("seg") == F.expr("(length - 1) div 500")) & (F.col("length") % 500 != 0), "last").otherwise("whole")
    return g.groupBy(kind.alias("kind"), census.segment_length(F.col("length"), F.col("seg")).alias("seg_m")).agg(F.count("*").alias("n"))


@query(_GEO + "SELECT low, origin, count(*) AS n FROM (SELECT origin, CASE WHEN length >= 1000 THEN 1000 WHEN length >= 500 THEN 500 WHEN length >= 200 THEN 200 WHEN length >= 0 THEN 0 END::BIGINT AS low FROM g) GROUP BY ALL")
def length_bands(spark, sf):
    return _geometry(spark, sf).groupBy(census.band(F.col("length"), [0, 200, 500, 1000]).alias("low"), "origin").agg(F.count("*").alias("n"))


@query(_GEO + _COVER + " SELECT 'unmatched' AS what, count(*) AS n FROM u WHERE link NOT IN (SELECT link FROM g) UNION ALL SELECT 'bad', count(*) FROM u JOIN g USING (link) WHERE origin = 'bad' UNION ALL SELECT 'unused', count(*) FROM g WHERE link NOT IN (SELECT link FROM u)")
def geometry_misses(spark, sf):
    """Anti joins: observed links without geometry, with a bad key, and geometry never observed."""
    g = _geometry(spark, sf)
    u = table(spark, sf, "lineitem", "l_partkey").select(F.col("l_partkey").cast("string").alias("link")).distinct()
    n = lambda d, what: d.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return n(u.join(g, "link", "left_anti"), "unmatched").union(n(u.join(g.where("origin = 'bad'"), "link", "left_semi"), "bad")).union(n(g.join(u, "link", "left_anti"), "unused"))


@query(with_("p", "b") + 'SELECT link, "window", max(bin)::BIGINT + 1 AS n_bins FROM b GROUP BY ALL')
def spatial_domain(spark, sf):
    return census.spatial_domain(base.bins(spark, sf), CELL)


# Sampling and statistics

_STAGE = """, c0 AS (SELECT link, "window", k_usable, "window" // 31536000 AS day, ('0x' || substring(md5(concat_ws('|', link, "window")), 1, 8))::BIGINT % 16 AS bucket FROM k WHERE k_usable >= 3),
f AS (SELECT day, bucket, row_number() OVER (PARTITION BY day ORDER BY md5(concat_ws('|', '7', day, bucket)), bucket) AS r, count(*) OVER (PARTITION BY day) AS have FROM (SELECT DISTINCT day, bucket FROM c0)),
c1 AS (SELECT c0.*, have, count(*) OVER (PARTITION BY day, bucket) AS eligible, row_number() OVER (PARTITION BY day, bucket ORDER BY md5(concat_ws('|', '7', link, "window")), link, "window") AS r2 FROM c0 JOIN f USING (day, bucket) WHERE r <= 4),
ts AS (SELECT day, bucket, link, "window", k_usable, round((have::DOUBLE / least(have, 4)) * (eligible::DOUBLE / least(eligible, 3)), 6) AS weight FROM c1 WHERE r2 <= 3)
"""


def _two_stage(spark, sf):
    return census.two_stage(base.cells(spark, sf), 4, 3, 7)


@query(with_("p", "b", "c", "k") + _STAGE + "SELECT * FROM ts")
def two_stage_sample(spark, sf):
    return _two_stage(spark, sf)


@query(with_("p", "b", "c", "k") + _STAGE + "SELECT day, round(sum((weight * k_usable)::DECIMAL(30,6))::DOUBLE / nullif(sum((weight * 1)::DECIMAL(30,6))::DOUBLE, 0), 6) AS ratio FROM ts GROUP BY day")
def weighted_ratio(spark, sf):
    return census.weighted_ratio(_two_stage(spark, sf).withColumn("one", F.lit(1)), "k_usable", "one", "weight", ["day"])


@query(with_("p", "b", "c", "k") + _STAGE + ", q AS (SELECT unnest([0.25, 0.5, 0.75])::DOUBLE AS q), h AS (SELECT k_usable, sum(weight::DECIMAL(30,6)) AS w FROM ts GROUP BY 1), s AS (SELECT k_usable, sum(w) OVER (ORDER BY k_usable) AS c, sum(w) OVER () AS a FROM h) SELECT q, min(k_usable) AS k_usable FROM s, q WHERE c >= q * a GROUP BY q")
def weighted_quantile(spark, sf):
    t = _two_stage(spark, sf).withColumn("weight", F.col("weight").cast("decimal(30,6)"))
    return census.weighted_quantiles(t, "k_usable", "weight", [0.25, 0.5, 0.75])


_OBSERVED = ', bo AS (SELECT link, "window", sample_id, bin, bool_and(valid) AS bin_valid, bool_or(observed) AS any_observed FROM p GROUP BY ALL)'


@query(with_("p") + _OBSERVED + """ SELECT link, "window", sample_id, count(*) AS n_present, count(*) FILTER (bin_valid) AS n_valid, count(*) FILTER (NOT bin_valid) AS n_invalid, count(*) FILTER (any_observed) AS n_observed, count(*) FILTER (bin_valid AND NOT any_observed) AS n_valid_unobserved,
  (max(bin) - min(bin) + 1)::BIGINT AS span, (max(bin) - min(bin) + 1 - count(*))::BIGINT AS interior_missing, (max(bin) - min(bin) + 1 - count(*) FILTER (any_observed))::BIGINT AS interior_unobserved FROM bo GROUP BY link, "window", sample_id""")
def gap_counts(spark, sf):
    b = pieces(spark, sf).groupBy(*CELL, "sample_id", "bin").agg(F.min("valid").alias("bin_valid"), F.max("observed").alias("any_observed"))
    return census.gap_counts(b, [*CELL, "sample_id"])


@query(with_("p", "b") + ', x AS (SELECT *, bin - row_number() OVER (PARTITION BY link, "window", sample_id ORDER BY bin) AS g FROM b) SELECT link, "window", sample_id, min(bin) AS first, max(bin) AS last, count(*) AS n FROM x GROUP BY link, "window", sample_id, g')
def contiguous_runs(spark, sf):
    return census.runs(base.bins(spark, sf), [*CELL, "sample_id"], "bin")


@query(with_("p", "b", "c") + "SELECT link, least(greatest(floor(covered_m / 5.0)::BIGINT, 0), 20) AS slot, count(*) AS n, sum(n_present)::BIGINT AS weight FROM c GROUP BY ALL")
def numeric_histogram(spark, sf):
    """Fixed-width histogram with a weight; the last slot is open."""
    c = base.compact(spark, sf)
    slot = F.least(F.greatest(F.floor(F.col("covered_m") / 5.0), F.lit(0)), F.lit(20)).cast("long")
    return c.groupBy("link", slot.alias("slot")).agg(F.count("*").alias("n"), total("n_present").alias("weight"))


@query(with_("p", "b", "c") + ", y AS (SELECT link, \"window\" // 31536000 AS seed, sum(covered_m)::DOUBLE / count(*) AS v FROM c GROUP BY ALL) SELECT link, count(*) AS n_runs, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd FROM y GROUP BY link HAVING count(DISTINCT seed) >= 3")
def seed_summary(spark, sf):
    """Mean and deviation of a measure over at least three runs."""
    y = base.compact(spark, sf).groupBy("link", F.expr("window div 31536000").alias("seed")).agg((F.sum("covered_m").cast("double") / F.count("*")).alias("v"))
    return y.groupBy("link").agg(F.count("*").alias("n_runs"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("sd")).where("n_runs >= 3")


@query(with_("p", "b", "c", "k") + "SELECT n_periods, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM (SELECT link, \"window\" // 31536000 AS y, count(*) AS n_periods FROM k GROUP BY ALL) GROUP BY n_periods")
def period_presence(spark, sf):
    """How many links (by year) are present in how many periods, with shares."""
    x = base.cells(spark, sf).groupBy("link", F.expr("window div 31536000")).agg(F.count("*").alias("n_periods"))
    h = x.groupBy("n_periods").agg(F.count("*").alias("n"))
    all_ = h.agg(F.sum("n").alias("whole"))
    return h.join(F.broadcast(all_)).select("n_periods", "n", safe_ratio(F.col("n"), F.col("whole")).alias("share"))  # one row


# Lookup and export


@query(with_("p", "b", "c", "k") + 'SELECT * FROM k WHERE k_raw >= 5 ORDER BY link, "window" LIMIT 50 OFFSET 100')
def paged_cells(spark, sf):
    return census.page(base.cells(spark, sf), 100, 50, min_k=5)


@query(with_("p", "b", "c", "k") + 'SELECT link, "window", k_raw FROM (SELECT *, row_number() OVER (PARTITION BY link ORDER BY k_raw DESC, "window") AS r FROM k) WHERE r = 1')
def densest_cell(spark, sf):
    best = base.cells(spark, sf).groupBy("link").agg(F.max(F.struct("k_raw", (-F.col("window")).alias("w"))).alias("x"))
    return best.select("link", (-F.col("x.w")).alias("window"), F.col("x.k_raw").alias("k_raw"))


@query(with_("p", "b", "c", "k", "m") + ', d AS (SELECT link, "window", row_number() OVER (PARTITION BY link ORDER BY k_raw DESC, "window") AS r FROM k) SELECT m.link, m."window", group_index, m.sample_id, hidden, bin, time_sum, bin_valid FROM m JOIN b USING (link, "window", sample_id) JOIN d USING (link, "window") WHERE r = 1')
def locate_group(spark, sf):
    """Groups of the densest cell of each link, with members, masks and bins."""
    b = base.bins(spark, sf)
    c = core.compact(b)
    best = core.cells(c).groupBy("link").agg(F.max(F.struct("k_raw", (-F.col("window")).alias("w"))).alias("x")).select("link", (-F.col("x.w")).alias("window"))
    m = core.hide(core.members(c, base.M, base.SEED))
    return m.join(best, CELL, "left_semi").join(b.select(*CELL, "sample_id", "bin", "time_sum", "bin_valid"), [*CELL, "sample_id"]).select(*GROUP, "sample_id", "hidden", "bin", "time_sum", "bin_valid")


@query(with_("p") + """, x AS (SELECT link, sample_id, bin, string_agg(t || ':' || ratio || ':' || valid, ';' ORDER BY t, ratio, valid) AS s FROM p GROUP BY ALL)
SELECT link, sample_id, string_agg(bin || '=' || s, '|' ORDER BY bin) AS nested FROM x GROUP BY link, sample_id""")
def nested_pieces(spark, sf):
    """Two-level nesting, bins of pieces, as text here."""
    n = nested_export(pieces(spark, sf))
    inner = lambda p: F.array_join(F.transform(p, lambda x: F.concat_ws(":", x["t"], x["ratio"], x["valid"].cast("string"))), ";")
    return n.select("link", "sample_id", F.array_join(F.transform("bins", lambda b: F.concat(b["bin"].cast("string"), F.lit("="), inner(b["pieces"]))), "|").alias("nested"))


@query(with_("p", "b", "c") + ", x AS (SELECT link, sum(n_pieces)::BIGINT AS n, row_number() OVER (ORDER BY sum(n_pieces) DESC, link) AS r FROM c GROUP BY link) SELECT link, n FROM x WHERE r <= 3")
def top_links(spark, sf):
    return base.compact(spark, sf).groupBy("link").agg(total("n_pieces").alias("n")).orderBy(F.desc("n"), "link").limit(3)


@query("WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings WHERE embedding IS NOT NULL) SELECT i::BIGINT AS i, count(*) AS n, round(sum(x::DECIMAL(30,12))::DOUBLE / count(*), 9) AS mean, count(*) FILTER (x > 0) AS n_positive FROM e GROUP BY i")
def array_columns(spark, sf):
    """Aligned explode of an array column with its positions."""
    e = table(spark, sf, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("i", "x"))
    x = F.col("x").cast("double")
    return e.groupBy(long("i").alias("i")).agg(F.count("*").alias("n"), F.round(F.sum(x.cast("decimal(30,12)")).cast("double") / F.count("*"), 9).alias("mean"), F.count_if(x > 0).alias("n_positive"))


# Rows only: results that depend on NumPy's generator


@query()
def exact_groups(spark, sf):
    from ..operators.exact import exact_hide, exact_members, located

    return exact_hide(exact_members(located(base.compact(spark, sf)), base.M)).select(*GROUP, "group_id", "member", "sample_id", "group_size", "k", "hidden")


@query()
def bootstrap_ci(spark, sf):
    from ..operators.exact import bootstrap_difference

    p = base.predicted(spark, sf)
    rows = p.select(*CELL, F.abs(F.col("prediction") - F.col("truth")).alias("a"), F.col("truth").cast("double").alias("b"))
    found = bootstrap_difference(rows, "a", "b", times=500)
    return spark.createDataFrame([tuple(found.values())], "estimate double, low double, high double")


@query()
def source_inventory(spark, sf):
    from ..sources.tables import inventory

    return inventory(spark, f"{sf}/lineitem.parquet")


from . import more as _more  # noqa: E402, F401 - it registers further queries here
