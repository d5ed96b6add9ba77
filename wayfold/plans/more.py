"""Further registered queries: passes under the data contract, partitions that stay, joins of artifacts, packing, picks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.timing import epoch, json_safe, seeded
from ..operators import census, core, passes
from ..operators.core import CELL, GROUP, long, total
from ..sources.tables import table
from . import base
from .base import M, SEED, with_
from .queries import query

# Passes from raw records. The driver's tables as raw records: whole cents and seconds, so that no result depends on rounding.

_RAW = """raw AS (SELECT o_orderstatus AS map, o_orderpriority AS link, concat_ws('#', o_orderkey, o_custkey) AS sample, l_linenumber % 3 AS segment, CASE WHEN l_discount > 0 THEN 1 ELSE 0 END AS mark,
  (50 * (l_linenumber % 3) + 10 + l_quantity::INT - 1) AS place, l_suppkey AS part, epoch(o_orderdate)::BIGINT AS reference, CASE WHEN l_linestatus = 'O' THEN (l_partkey % 900 + l_quantity::INT)::BIGINT END AS since,
  CASE WHEN l_returnflag <> 'R' THEN l_quantity::INT::BIGINT END AS spent, 1 + l_linenumber % 10 AS tenths, l_linestatus = 'O' AS gps FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
ps AS (SELECT map, link, sample, segment, max(reference) + min(since - spent) AS entry, count(*) AS n_parts, count(*) FILTER (gps) AS n_gps, count(spent) AS n_timed,
  array_to_string(list(place - 50 * segment - 10 ORDER BY place, part, coalesce(spent, 99), tenths, gps), ',') AS bins, array_to_string(list(coalesce(spent, -1) ORDER BY place, part, coalesce(spent, 99), tenths, gps), ',') AS times,
  array_to_string(list(tenths ORDER BY place, part, coalesce(spent, 99), tenths, gps), ',') AS tenths FROM raw WHERE mark = 1 GROUP BY map, link, sample, segment HAVING min(since - spent) IS NOT NULL)"""


def _raw(spark, sf):
    o = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    l = table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    quantity, segment = F.col("l_quantity").cast("int"), F.col("l_linenumber") % 3
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("o_orderstatus").alias("map"),
        F.col("o_orderpriority").alias("link"),
        F.concat_ws("#", "o_orderkey", "o_custkey").alias("sample"),
        segment.alias("segment"),
        (F.col("l_discount") > 0).cast("int").alias("mark"),
        (50 * segment + 10 + quantity - 1).alias("place"),
        F.col("l_suppkey").alias("part"),
        epoch(F.col("o_orderdate")).cast("double").alias("reference"),
        F.when(F.col("l_linestatus") == "O", (F.col("l_partkey") % 900 + quantity).cast("double")).alias("since"),
        F.when(F.col("l_returnflag") != "R", quantity.cast("double")).alias("spent"),
        ((1 + F.col("l_linenumber") % 10) / 10).alias("share"),
        (F.col("l_linestatus") == "O").alias("gps"),
    )


@query("WITH " + _RAW + """ SELECT map, link, sample, segment, (entry // 600) * 600 AS "window", entry % 600 AS "offset", strftime(to_timestamp((entry // 600) * 600) AT TIME ZONE 'UTC', '%Y%m%d') AS day,
  n_parts, n_gps, n_timed, bins, times, tenths FROM ps""")
def observed_passes(spark, sf):
    """Raw records to passes: contract checks, entry time, window, day, ordered parts (arrays as text)."""
    text = lambda c: F.array_join(c.cast("array<string>"), ",")
    p = passes.observations(_raw(spark, sf))
    times = F.transform("spent", lambda x: F.when(F.isnan(x), -1).otherwise(x).cast("long"))
    return p.select(*passes.PASS, "window", long("offset").alias("offset"), "day", long("n_parts").alias("n_parts"), F.size(F.filter("gps", lambda x: x)).cast("long").alias("n_gps"), F.size(F.filter("timed", lambda x: x)).cast("long").alias("n_timed"), text(F.col("bin")).alias("bins"), text(times).alias("times"), text(F.col("tenths")).alias("tenths"))


@query("WITH " + _RAW + """ SELECT place - 50 * segment - 10 AS bin, count(*) AS n, count(spent) AS n_timed, sum(spent)::BIGINT AS spent, sum(raw.tenths)::BIGINT AS tenths, count(*) FILTER (raw.gps) AS n_gps
  FROM raw JOIN ps USING (map, link, sample, segment) WHERE mark = 1 GROUP BY 1""")
def exploded_parts(spark, sf):
    """Passes back to one row per part, and what the bins hold."""
    e = passes.explode_parts(passes.observations(_raw(spark, sf)))
    return e.groupBy("bin").agg(F.count("*").alias("n"), F.count_if("timed").alias("n_timed"), F.sum(json_safe(F.col("spent").cast("double"))).cast("long").alias("spent"), total("tenths").alias("tenths"), F.count_if("gps").alias("n_gps"))


# Sources


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events WHERE value > 0 GROUP BY event_type")
def view_by_statement(spark, sf):
    """A view declared and queried in SQL."""
    table(spark, sf, "events").createOrReplaceTempView("wayfold_events_source")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW wayfold_positive_events AS SELECT event_type, user_id, value FROM wayfold_events_source WHERE value > 0")
    return spark.sql("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users FROM wayfold_positive_events GROUP BY event_type")


@query("SELECT 'orders' AS source, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY o_orderstatus")
def name_from_path(spark, sf):
    """A column that only the file's path holds."""
    name = F.regexp_extract("_metadata.file_path", r"([a-z]+)\.parquet", 1)
    return spark.read.parquet(f"{sf}/orders.parquet").select(name.alias("source"), F.col("o_orderstatus").alias("status")).groupBy("source", "status").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT h.h AS hour, t.event_type FROM (SELECT unnest(range(24)) AS h) h, (SELECT DISTINCT event_type FROM events) t)
SELECT g.hour, g.event_type, count(e.event_id) AS n FROM g LEFT JOIN events e ON e.event_type = g.event_type AND hour(e.ts) = g.hour AND e.value > 150 GROUP BY 1, 2""")
def partitions_with_sentinels(spark, sf):
    """Every partition (hour and type) stays, also where nothing is left in it: rows are united with one sentinel each."""
    e = table(spark, sf, "events", "ts", "event_type", "value")
    rows = e.where("value > 150").select(F.hour("ts").cast("long").alias("hour"), "event_type", F.lit(1).alias("real"))
    types = e.select("event_type").distinct()
    sentinels = types.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"), "event_type", F.lit(0).alias("real"))
    return rows.unionByName(sentinels).groupBy("hour", "event_type").agg(total("real").alias("n"))


# Joins


_ACTIVE = """a AS (SELECT link FROM k GROUP BY link HAVING sum(k_raw) >= 100 AND count(DISTINCT strftime(to_timestamp("window") AT TIME ZONE 'UTC', '%Y%m%d')) >= 3 AND count(DISTINCT "window") >= 3 AND count(DISTINCT "window" // 31536000) >= 2)"""


@query(with_("p", "b", "c", "k") + f", {_ACTIVE} SELECT k.* FROM k JOIN a USING (link)")
def cells_of_active_links(spark, sf):
    """Cells of the links that are active enough: sums and distinct counts over their cells reach thresholds."""
    cell = base.cells(spark, sf)
    return cell.join(census.active_links(census.link_profile(cell), 100, 3, 3, 2).select("link"), "link", "left_semi").select(*cell.columns)


@query(with_("p", "b", "c", "k") + """SELECT link, "window", sample_id, n_present, n_valid, covered_m, k_usable AS k, round(n_valid / k_usable, 6) AS per_member FROM c LEFT JOIN (SELECT * FROM k WHERE k_usable >= 3) USING (link, "window")""")
def statistics_with_k(spark, sf):
    """Trajectory statistics with the K of their cell, null where the cell is too small."""
    obs = base.compact(spark, sf)
    k = core.cells(obs).where("k_usable >= 3").select(*CELL, F.col("k_usable").alias("k"))
    return obs.join(k, CELL, "left").select(*CELL, "sample_id", "n_present", "n_valid", "covered_m", "k", F.round(F.col("n_valid") / F.col("k"), 6).alias("per_member"))


@query(with_("p", "b", "c", "k", "m") + """, t AS (SELECT link, count(*) AS usable FROM c WHERE usable GROUP BY link), q AS (SELECT link, count(*) AS retained, count(DISTINCT ("window", group_index)) AS n_groups FROM m GROUP BY link),
d AS (SELECT link, sum(CASE WHEN k_usable < 3 THEN k_usable WHEN k_usable % 16 < 3 THEN k_usable % 16 ELSE 0 END)::BIGINT AS dropped FROM k GROUP BY link)
SELECT link, usable, coalesce(retained, 0) AS retained, coalesce(n_groups, 0) AS n_groups, dropped, coalesce(retained, 0) + dropped = usable AS agrees FROM t JOIN d USING (link) LEFT JOIN q USING (link)""")
def totals_and_retention(spark, sf):
    """Usable totals against the retained members and the tails dropped; `agrees` must hold in every row."""
    obs = base.compact(spark, sf).persist()
    cell = core.cells(obs)
    tail = F.when(F.col("k_usable") < 3, F.col("k_usable")).when(F.col("k_usable") % M < 3, F.col("k_usable") % M).otherwise(0)
    totals = cell.groupBy("link").agg(total("k_usable").alias("usable"), total(tail).alias("dropped")).where("usable > 0")
    kept = core.groups(core.members(obs, M, SEED)).groupBy("link").agg(total("group_size").alias("retained"), F.count("*").alias("n_groups"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    rows = totals.join(kept, "link", "left")
    return rows.select("link", "usable", zero("retained").alias("retained"), zero("n_groups").alias("n_groups"), "dropped", (zero("retained") + F.col("dropped") == F.col("usable")).alias("agrees"))


@query(with_("p", "b", "c", "m") + """, g AS (SELECT link, "window", group_index, max(group_size) AS size, count(*) FILTER (hidden) AS hidden FROM m GROUP BY ALL)
SELECT link, count(*) AS n_groups, sum(size)::BIGINT AS retained, sum(size // 2)::BIGINT AS to_hide, sum(hidden)::BIGINT AS hidden, sum(size // 2) = sum(hidden) AS agrees FROM g GROUP BY link""")
def retention_and_masks(spark, sf):
    """Members retained against the masks: floor(n / 2) of each group is hidden."""
    g = core.groups(base.masked(spark, sf))
    half = F.expr("group_size div 2")
    return g.groupBy("link").agg(F.count("*").alias("n_groups"), total("group_size").alias("retained"), total(half).alias("to_hide"), total("n_hidden").alias("hidden")).withColumn("agrees", F.col("to_hide") == F.col("hidden"))


# Order and picks


@query(with_("p", "b", "c") + """SELECT link, "window", sample_id, row_number() OVER (PARTITION BY link, "window" ORDER BY sample_id) - 1 AS position FROM c""")
def lexicographic_rows(spark, sf):
    """The place of each row in the order of its identity, within its cell."""
    return base.compact(spark, sf).select(*CELL, "sample_id", (F.row_number().over(Window.partitionBy(*CELL).orderBy("sample_id")) - 1).cast("long").alias("position"))


@query(with_("p", "b", "c", "k") + """, n AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY "window") - 1 AS place, count(*) OVER (PARTITION BY link) AS n FROM k),
s AS (SELECT unnest(range(5)) AS i) SELECT DISTINCT link, "window", k_raw, place FROM n, s WHERE place = (i * (n - 1)) // 4""")
def evenly_spaced_cells(spark, sf):
    """Five cells of each link, evenly spaced over its windows, first and last included (fewer where a link has fewer)."""
    w = Window.partitionBy("link")
    n = base.cells(spark, sf).withColumn("place", (F.row_number().over(w.orderBy("window")) - 1).cast("long")).withColumn("n", F.count("*").over(w))
    picks = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.floor(i * (F.col("n") - 1) / 4).cast("long"))
    return n.where(F.array_contains(picks, F.col("place"))).select(*CELL, "k_raw", "place")


@query(with_("p", "b", "c", "k") + """, a AS (SELECT link, "window", 'densest' AS category FROM k ORDER BY k_usable DESC, link, "window" LIMIT 3),
b2 AS (SELECT link, "window", 'widest' AS category FROM k WHERE (link, "window") NOT IN (SELECT (link, "window") FROM a) ORDER BY max_covered_m DESC, link, "window" LIMIT 3),
c2 AS (SELECT link, "window", 'sparsest' AS category FROM k WHERE (link, "window") NOT IN (SELECT (link, "window") FROM a UNION ALL SELECT (link, "window") FROM b2) ORDER BY k_raw, link, "window" LIMIT 3)
SELECT * FROM a UNION ALL SELECT * FROM b2 UNION ALL SELECT * FROM c2""")
def picks_without_repeats(spark, sf):
    """Three cells of each category, none twice: a later category takes its next best."""
    cell, taken = base.cells(spark, sf), None
    for category, order in (("densest", F.desc("k_usable")), ("widest", F.desc("max_covered_m")), ("sparsest", F.asc("k_raw"))):
        free = cell if taken is None else cell.join(taken.select(*CELL), CELL, "left_anti")
        top = free.orderBy(order, *CELL).limit(3).select(*CELL, F.lit(category).alias("category"))
        taken = top if taken is None else taken.unionByName(top)
    return taken


@query(with_("p", "b", "c", "m") + """, g AS (SELECT DISTINCT link, "window", group_index FROM m),
o AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY md5(concat_ws('|', '7', '1', link, "window", group_index)), "window", group_index) - 1 AS position FROM g) SELECT *, position % 3 AS reader FROM o WHERE position < 12""")
def seeded_group_selection(spark, sf):
    """At most twelve groups of each link in the seeded order of an epoch, dealt to three readers."""
    g = core.members(base.compact(spark, sf), M, SEED).select(*GROUP).distinct()
    order = seeded("7|1", *[F.col(c) for c in GROUP])
    position = (F.row_number().over(Window.partitionBy("link").orderBy(order, "window", "group_index")) - 1).cast("long")
    return g.withColumn("position", position).where("position < 12").withColumn("reader", (F.col("position") % 3).cast("long"))


@query(with_("p", "b", "c", "m") + f"""SELECT link, "window", group_index, array_to_string(list_resize(list(covered_m ORDER BY member), {M}, 0), ',') AS covered, array_to_string(list_resize(list(hidden::INT ORDER BY member), {M}, 0), ',') AS hidden,
  array_to_string(list_resize(list(1 ORDER BY member), {M}, 0), ',') AS real FROM m GROUP BY ALL""")
def packed_groups(spark, sf):
    """Groups as rows of a fixed width: members in order, padded with zeros, beside a row that says which are real."""
    g = base.masked(spark, sf).groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct("member", "covered_m", "hidden"))).alias("z"))
    row = lambda f: F.array_join(F.concat(F.transform("z", lambda x: f(x).cast("string")), F.array_repeat(F.lit("0"), F.lit(M) - F.size("z"))), ",")
    return g.select(*GROUP, row(lambda x: x["covered_m"]).alias("covered"), row(lambda x: x["hidden"].cast("int")).alias("hidden"), row(lambda x: F.lit(1)).alias("real"))


# Histograms


@query(with_("p") + "SELECT link, floor(log10(t))::BIGINT AS power, count(*) AS n, min(t) AS low, max(t) AS high FROM p WHERE t > 0 GROUP BY 1, 2")
def log_bins(spark, sf):
    """Histogram of times by powers of ten."""
    from ..sources.tables import pieces

    p = pieces(spark, sf).where("t > 0")
    return p.groupBy("link", F.floor(F.log10("t")).cast("long").alias("power")).agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"))


@query("""SELECT l_returnflag AS flag, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers, sum(l_quantity::BIGINT)::BIGINT AS quantity,
  round(sum(l_quantity::BIGINT)::DOUBLE / sum(count(*)) OVER (), 9) AS share FROM lineitem GROUP BY l_returnflag""")
def shares_of_total(spark, sf):
    """Totals of a class and their share of all rows."""
    l = table(spark, sf, "lineitem", "l_returnflag", "l_suppkey", "l_quantity")
    g = l.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("n_suppliers"), total(F.col("l_quantity").cast("long")).alias("quantity"))
    everything = l.agg(F.count("*").alias("all"))
    return g.crossJoin(F.broadcast(everything)).select("flag", "n", "n_suppliers", "quantity", F.round(F.col("quantity") / F.col("all"), 9).alias("share"))  # one row
