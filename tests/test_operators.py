import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import census, core, exact, passes
from wayfold.sources import publish, tables

RAW = "map string, link string, sample string, segment long, mark long, place long, part long, reference double, since double, spent double, share double, gps boolean"
DAY = 1_700_000_040.0
NAN = float("nan")


def raw(spark, *rows, reference=DAY):
    return spark.createDataFrame([("m", "L", "s1", 1, mark, place, part, reference, since, spent, share, None) for mark, place, part, since, spent, share in rows], RAW)


def test_a_part_without_time_does_not_hide_the_pass(spark):
    found = passes.observations(raw(spark, (1, 60, 1, None, NAN, 0.3), (1, 60, 0, 47.5, 2.5, 0.7), (1, 109, 0, NAN, 3.0, 1.0), (0, 61, 0, 1.0, 1.0, 1.0))).collect()
    assert len(found) == 1
    r = found[0]
    assert (r.bin, r.tenths, r.timed, r.gps) == ([0, 0, 49], [7, 3, 10], [True, False, True], [False] * 3)
    assert r.window == 1_700_000_000 // 600 * 600 and r.offset == DAY + 45 - r.window and r.spent[0] == 2.5 and math.isnan(r.spent[1])
    assert r.day == "20231114" and 0 <= r.bucket < 128
    assert passes.observations(raw(spark, (1, 60, 0, None, 2.0, 1.0))).count() == 0
    assert sorted((x.bin, x.tenths) for x in passes.explode_parts(passes.observations(raw(spark, (1, 60, 0, 9.0, 1.0, 0.4), (1, 63, 0, 9.0, 1.0, 1.0)))).collect()) == [(0, 4), (3, 10)]


@pytest.mark.parametrize("bad", [(1, 59, 0, 5.0, 1.0, 1.0), (1, 110, 0, 5.0, 1.0, 1.0), (1, 60, 0, 5.0, -1.0, 1.0), (1, 60, 0, 5.0, 1.0, 0.0), (1, 60, 0, float("inf"), 1.0, 1.0), (1, 60, 0, 5.0, 1.0, None)])
def test_contract_breach_is_an_error(spark, bad):
    with pytest.raises(Exception, match="bin outside|negative or not finite|share outside|since the reference"):
        passes.observations(raw(spark, bad)).collect()


@pytest.mark.parametrize("reference", [NAN, float("inf"), None])
def test_a_reference_time_must_be_finite(spark, reference):
    with pytest.raises(Exception, match="reference time is not finite"):
        passes.observations(raw(spark, (1, 60, 0, 5.0, 1.0, 1.0), reference=reference)).collect()


def obs(spark, sizes):
    rows = [("L", w, f"{w}-{k:04d}", 1, True, 10) for w, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "link string, window long, sample_id string, n_valid long, usable boolean, covered_m long")


@pytest.mark.parametrize("make", [core.members, exact.exact_members])
def test_groups_of_64_and_dropped_tails(spark, make):
    m = make(exact.located(obs(spark, {10: 130, 20: 65, 30: 67, 40: 2})), 64)
    sizes = sorted((r.window, r.group_index, r["count"]) for r in m.groupBy("window", "group_index").count().collect())
    assert sizes == [(10, 0, 64), (10, 1, 64), (20, 0, 64), (30, 0, 64), (30, 1, 3)]


@pytest.mark.parametrize("hide", [core.hide, exact.exact_hide])
def test_half_of_each_group_is_hidden(spark, hide):
    m = exact.exact_members(exact.located(obs(spark, {1: 3, 2: 5, 3: 64})), 64)
    assert {r.window: r.h for r in hide(m).groupBy("window").agg(F.count_if("hidden").alias("h")).collect()} == {1: 1, 2: 2, 3: 32}


def seed_of(*parts):
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=8).digest(), "little")


def test_exact_groups_and_masks_follow_the_seeds(spark):
    rows = [("20240101", 5, -9, "L", 1, f"s{k:03d}", 1, k % 7 != 3, 10) for k in range(90)]
    d = spark.createDataFrame(rows, "day string, bucket int, cell_id long, link string, window long, sample_id string, n_valid long, usable boolean, covered_m long")
    got = exact.exact_hide(exact.exact_members(d, 16, seed=3), epoch=2).collect()
    usable = sorted(r[5] for r in rows if r[7])
    order = [usable[k] for k in np.random.default_rng(seed_of(3, "20240101", 5, -9, "members")).permutation(len(usable))]
    want = {}
    for g in range(0, len(order), 16):
        some = order[g : g + 16]
        if len(some) >= 3:
            name = f"groups-v1-m16/20240101/5/-9/{g // 16}"
            hidden = np.random.default_rng(seed_of(name, 2)).choice(np.arange(len(some)), size=len(some) // 2, replace=False)
            want |= {s: (name, k, k in hidden) for k, s in enumerate(some)}
    assert {r.sample_id: (r.group_id, r.member, r.hidden) for r in got} == want
    picked = exact.exact_selection(exact.exact_members(d, 16, seed=3), most=3, seed=3, epoch=2).collect()
    n = len({x[0] for x in want.values()})
    by = np.random.default_rng(seed_of(3, 2, "20240101", 5, "groups")).permutation(n).tolist()
    chosen = np.random.default_rng(seed_of(3, 2, "20240101", 5, "select")).permutation(n)[:3].tolist()
    assert [r.group_index for r in sorted(picked, key=lambda r: r.position)] == [g for g in by if g in chosen]


def test_ratio_interval_resamples_clusters_and_cells(spark):
    d = spark.createDataFrame([(s, c, 1, (k + c) % 4, 4) for s in range(2) for c in range(5) for k in range(6)], "s int, c int, w int, n int, d int")
    r = exact.ratio_interval(d, "s", "c", "n", "d", "w", times=300)
    flat = exact.ratio_interval(d.withColumn("n", F.lit(1)), "s", "c", "n", "d", "w", times=50)
    assert r["low"] < r["ratio"] < r["high"] and flat == {"ratio": 0.25, "low": 0.25, "high": 0.25}
    assert exact.ratio_interval(d.withColumn("n", F.lit(0)), "s", "c", "n", "d", "w")["low"] is None
    with pytest.raises(ValueError):
        exact.ratio_interval(d, "s", "c", "n", "d", "w", most=10)


def test_visible_mean_and_fallback(spark):
    bins = spark.createDataFrame([("L", 0, "a", 0, 4, 1, True), ("L", 0, "b", 0, 8, 1, True), ("L", 0, "b", 1, 3, 1, True), ("L", 0, "c", 5, 9, 1, True)], "link string, window long, sample_id string, bin int, time_sum long, ratio_sum long, bin_valid boolean")
    m = spark.createDataFrame([("L", 0, 0, s, 3, 3, h, 1, 1) for s, h in (("a", False), ("b", True), ("c", False))], "link string, window long, group_index long, sample_id string, group_size long, k long, hidden boolean, n_valid long, covered_m long")
    got = {r.bin: (r.prediction, r.support, r.fallback) for r in core.predictions(bins, m).collect()}
    assert got == {0: (4.0, 1, False), 1: (6.5, 0, True)}


def test_bitmaps_and_gap(spark):
    p = spark.createDataFrame([("L", 0, "s", b, 1, r, v) for b, r, v in ((0, 10, True), (0, 3, False), (2, 4, True))], "link string, window long, sample_id string, bin int, t long, ratio long, valid boolean")
    r = core.compact(core.fold_bins(p)).first()
    assert (r.n_present, r.n_valid, r.has_internal_gap, r.covered_m, r.present_bits, r.valid_bits) == (2, 1, True, 17, 0b101, 0b100)


def test_weighted_ratio_29_34(spark):
    d = spark.createDataFrame([(2, 1, 2), (3, 9, 10)], "weight int, num int, den int")
    assert census.weighted_ratio(d, "num", "den", "weight", []).first().ratio == round(29 / 34, 6)


def test_symmetric_difference_sees_both_sides(spark):
    a, b = spark.createDataFrame([(1.0,), (float("nan"),)], "x double"), spark.createDataFrame([(float("nan"),), (2.0,)], "x double")
    assert sorted((r.x, r.side) for r in census.symmetric_difference(a, b).collect()) == [(1.0, "left"), (2.0, "right")]


def test_publish_never_overwrites_and_sees_changes(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(10).write.parquet(src)
    publish.publish(spark, out, [src], lambda: spark.read.parquet(src))
    assert spark.read.parquet(out).count() == 10
    with pytest.raises(FileExistsError):
        publish.publish(spark, out, [src], lambda: spark.range(1))

    def change():
        spark.range(5).write.mode("append").parquet(src)
        return spark.range(1)

    with pytest.raises(RuntimeError):
        publish.publish(spark, str(tmp_path / "other"), [src], change)
    with pytest.raises(ValueError, match="come back equal"):
        publish.publish(spark, str(tmp_path / "random"), [src], lambda: spark.range(9).select(F.rand().alias("x")))
    (tmp_path / "busy.lock").write_text("")
    with pytest.raises(FileExistsError, match="being published"):
        publish.publish(spark, str(tmp_path / "busy"), [src], lambda: spark.range(1))
    manifest = publish.publish(spark, str(tmp_path / "last"), [src], lambda: spark.range(4))
    assert manifest["rows"] == 4 and publish.verify_copy(spark, str(tmp_path / "last"), manifest)
    spark.range(1).write.mode("append").parquet(str(tmp_path / "last"))
    assert not publish.verify_copy(spark, str(tmp_path / "last"), manifest)
    assert not [p for p in tmp_path.iterdir() if ".attempt-" in p.name or p.name in ("other", "random", "last.lock")]


def test_history_drops_only_an_unfinished_last_line(spark, tmp_path):
    path = tmp_path / "h.jsonl"
    path.write_text('{"epoch": 1}\n{"epoch": 2}\n{"epo')
    assert sorted(r.epoch for r in tables.json_history(spark, str(path), "epoch int").collect()) == [1, 2]
    path.write_text('{"epoch": 1}\n{"epoch": 2}')
    assert tables.json_history(spark, str(path), "epoch int").count() == 2
    path.write_text('{"epoch": 1}\n{"ep\n{"epoch": 2}\n')
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        tables.json_history(spark, str(path), "epoch int").collect()


def test_a_cell_is_read_from_its_partition_and_days_from_paths(spark, tmp_path):
    root = str(tmp_path / "r")
    d = spark.createDataFrame([("20240101", 0, 5, 1), ("20240102", 1, 6, 2), ("20240102", 1, 6, 3)], "day string, bucket int, cell_id long, x int")
    d.write.partitionBy("day", "bucket").parquet(root)
    place = d.select("cell_id", "day", "bucket").distinct()
    assert sorted(r.x for r in tables.partition_of(spark, root, place, 6).collect()) == [2, 3]
    with pytest.raises(KeyError):
        tables.partition_of(spark, root, place, 7)
    assert sorted((r.x, r.file_day) for r in tables.with_file_day(spark, root).collect()) == [(1, "20240101"), (2, "20240102"), (3, "20240102")]


def test_scans_days_and_documents(spark, tmp_path):
    src = str(tmp_path / "t")
    spark.range(20).selectExpr("id", "id * 2 AS y", "'20240101' AS day").write.parquet(src)
    assert tables.scan(spark, src + "," + src, "y", where="id > 15").count() == 8
    publish.write_days(spark.read.parquet(src), str(tmp_path / "d"), 2)
    assert spark.read.parquet(str(tmp_path / "d")).count() == 20 and (tmp_path / "d" / "day=20240101").is_dir()
    publish.write_document(spark, {"a": [float("nan"), 1.0]}, str(tmp_path / "doc"))
    assert spark.read.text(str(tmp_path / "doc")).first()[0] == '{"a": [null, 1.0]}'
    a = spark.range(3)
    assert publish.same_rows(a, a.orderBy(F.desc("id"))) and not publish.same_rows(a, a.union(a.limit(1)))


def test_cache_follows_inputs(spark, tmp_path):
    src, out, calls = str(tmp_path / "in"), str(tmp_path / "c"), []
    spark.range(3).write.parquet(src)

    def build():
        calls.append(1)
        return spark.read.parquet(src)

    for _ in range(2):
        assert publish.cached(spark, out, [src], "q", build).count() == 3
    spark.range(4).write.mode("append").parquet(src)
    assert publish.cached(spark, out, [src], "q", build).count() == 7 and len(calls) == 2


def test_csv_needs_its_columns_and_day_buckets_are_unique(spark, tmp_path):
    publish.write_csv(spark.createDataFrame([(1, [1, 2])], "a int, b array<int>"), str(tmp_path / "c"))
    with pytest.raises(ValueError, match="lacks z"):
        tables.typed_csv(spark, str(tmp_path / "c"), "a int, b string", ["a", "z"])
    d = spark.createDataFrame([("d1", 0, 1)], "day string, bucket int, x int")
    for r in "pq":
        d.write.partitionBy("day", "bucket").parquet(str(tmp_path / r))
    assert tables.day_buckets(spark, [str(tmp_path / "p")], ["d1"]).count() == 1
    with pytest.raises(ValueError, match="more than one root"):
        tables.day_buckets(spark, [str(tmp_path / "p"), str(tmp_path / "q")])


def test_stream_counts_equal_batch(spark, tmp_path):
    from wayfold.streaming.windows import window_counts

    rows = [(f"2024-01-01 00:{m:02d}:00", "a", 1.0) for m in (1, 5, 11, 45)]
    src = str(tmp_path / "s")
    spark.createDataFrame(rows, "ts string, k string, value double").selectExpr("cast(ts as timestamp) ts", "k", "value").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string, value double").parquet(src)
    q = window_counts(stream, "ts", "k").writeStream.format("memory").queryName("w").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("w").collect()) == [1, 2]


def test_bootstrap_holds_the_estimate(spark):
    d = spark.createDataFrame([("L", w, float(w % 3), 1.0) for w in range(60)], "link string, window long, a double, b double")
    r = exact.bootstrap_difference(d, "a", "b", times=300)
    assert abs(r["estimate"]) < 1e-9 and r["low"] < 0 < r["high"]
