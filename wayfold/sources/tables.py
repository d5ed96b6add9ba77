"""Scans: tables, globs, partitions, typed CSV, line-complete JSON, inventories and the piece view."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import epoch, window_start

MONTH = 2_592_000


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scan(spark: SparkSession, paths: str, *columns: str, where: Column | str | None = None) -> DataFrame:
    """Comma-separated paths and globs; the filter and the column list reach the Parquet scan."""
    df = spark.read.parquet(*[p for p in paths.split(",") if p])
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def day_buckets(spark: SparkSession, roots: list[str], days: list[str] | None = None) -> DataFrame:
    """Partitioned roots (day=/bucket=) as one table; the same partition under two roots is an error."""
    held: dict[str, str] = {}
    for r in roots:
        for uri, _, _ in listed(spark, r):
            if m := re.search(r"day=([^/]+)/bucket=([^/]+)/", uri):
                if held.setdefault(m[0], r) != r:
                    raise ValueError(f"{m[0].strip('/')} is under more than one root")
    parts = [spark.read.option("basePath", r).parquet(r) for r in roots]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.where(F.col("day").cast("string").isin(days)) if days else df


def partition_of(spark: SparkSession, root: str, place: DataFrame, cell_id: int) -> DataFrame:
    """The rows of one cell, read from its partition only: place(cell_id, day, bucket) says which that is."""
    found = place.where(F.col("cell_id") == cell_id).select("day", "bucket").distinct().take(2)
    if len(found) != 1:
        raise KeyError(f"cell {cell_id} is in {len(found)} partitions")
    return spark.read.option("basePath", root).parquet(f"{root}/day={found[0].day}/bucket={found[0].bucket}").where(F.col("cell_id") == cell_id)


def with_file_day(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files whose day is in their path only, as the column file_day (null where no path part names a day)."""
    day = F.regexp_extract("_metadata.file_path", r"day=([0-9]{8})", 1)
    return spark.read.option("recursiveFileLookup", True).parquet(path).withColumn("file_day", F.nullif(day, F.lit("")))


def typed_csv(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """CSV with a header; a missing required column fails before any row is read."""
    header = spark.read.option("header", True).csv(path).columns
    if missing := [c for c in required if c not in header]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def json_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; a last line without its line feed that is not whole is left out, any other malformed line is an error."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.split("value", "\n")
    parsed = lambda line: F.from_json(line, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    cut = F.get(lines, F.size(lines) - 1)
    unfinished = (F.trim(cut) == "") | parsed(cut)["_bad"].isNotNull()
    rows = whole.select(F.explode(F.when(unfinished, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)).alias("line")).where(F.trim("line") != "")
    rows = rows.select("line", parsed(F.col("line")).alias("row"))
    good = F.when(F.col("row._bad").isNull(), F.col("row")).otherwise(F.raise_error(F.concat(F.lit("a malformed line: "), F.col("line"))))
    return rows.select(good.alias("row")).select("row.*").drop("_bad")


def listed(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(uri, bytes, modification time in milliseconds) of the data files under a path, from one listing."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    files, out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        if not f.getPath().getName().startswith(("_", ".")):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return sorted(out)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(uri, bytes, mtime) of every data file under a path; compared before and after a build."""
    rows = spark.createDataFrame(listed(spark, path), "uri string, bytes long, ms long")
    return rows.select("uri", "bytes", F.timestamp_millis("ms").alias("mtime"))


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """A corpus by its marker: with a `_members` table, observations with their group; else observations alone.

    A corpus whose marker is there but whose table cannot be read fails; there is no silent fallback.
    """
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{root}/_members")
    if marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker):
        return spark.read.parquet(f"{root}/observations").join(spark.read.parquet(f"{root}/_members"), ["cell_id", "sample_id"], "left")
    return spark.read.parquet(root)


def pieces(spark: SparkSession, sf_dir: str, span: int = MONTH) -> DataFrame:
    """The driver tables as pieces: link, version, window, sample_id, bin, t (cents), ratio, valid, observed, marked."""
    o = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    l = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    o = o.withColumn("window", window_start(epoch(F.col("o_orderdate")), span))
    return l.join(o, l.l_orderkey == o.o_orderkey).select(
        F.col("o_orderpriority").alias("link"),
        F.col("o_orderstatus").alias("version"),
        "window",
        F.concat_ws("#", "o_orderkey", "o_orderpriority", "o_custkey", "window").alias("sample_id"),
        F.col("o_orderkey").alias("pass_id"),
        F.col("o_custkey").alias("traj"),
        (F.col("l_quantity").cast("int") - 1).alias("bin"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("t"),
        (1 + F.col("l_linenumber") % 10).cast("long").alias("ratio"),
        (F.col("l_returnflag") != "R").alias("valid"),
        (F.col("l_linestatus") == "O").alias("observed"),
        (F.col("l_discount") > 0).alias("marked"),
    )
