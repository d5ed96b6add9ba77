"""Sinks: Parquet, partitioned Parquet, CSV, JSON lines and text, cached results, round-trip checks, guarded publication."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.census import symmetric_difference
from .tables import listed


def write_days(df: DataFrame, path: str, files: int, mode: str = "errorifexists") -> None:
    """Partitioned by day, each day dealt out over `files` tasks so that one large day is not one task."""
    df.repartition(files, "day", F.pmod(F.monotonically_increasing_id(), F.lit(files))).write.mode(mode).option("compression", "zstd").partitionBy("day").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header for a small report; arrays, maps and structs as JSON text."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes]
    df.select(*flat).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_document(spark: SparkSession, document: dict, path: str) -> None:
    """A JSON document as text; NaN and infinities become null."""
    def safe(x):
        if isinstance(x, dict):
            return {k: safe(v) for k, v in x.items()}
        if isinstance(x, list | tuple):
            return [safe(v) for v in x]
        return None if isinstance(x, float) and (x != x or abs(x) == float("inf")) else x

    spark.createDataFrame([(json.dumps(safe(document), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def nested_export(pieces: DataFrame, path: str | None = None) -> DataFrame:
    """One row per sample: a list per bin, each a list of its pieces in order; written as JSON lines if a path is given."""
    bins = pieces.groupBy("link", "sample_id", "bin").agg(F.array_sort(F.collect_list(F.struct("t", "ratio", "valid"))).alias("pieces"))
    rows = bins.groupBy("link", "sample_id").agg(F.array_sort(F.collect_list(F.struct("bin", "pieces"))).alias("bins"))
    if path:
        rows.write.mode("overwrite").json(path)
    return rows


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, *inputs: str, text: str = "") -> str:
    """Digest of the query text and of path, size and time of every input file."""
    rows = sorted(tuple(map(str, r)) for p in inputs for r in listed(spark, p))
    return hashlib.sha256(json.dumps([text, rows]).encode()).hexdigest()


def cached(spark: SparkSession, path: str, inputs: list[str], text: str, build) -> DataFrame:
    """The result at `path` if text and inputs are unchanged, else build() written there, its manifest last."""
    mark = fingerprint(spark, *inputs, text=text)
    fs, manifest = _fs(spark, f"{path}.manifest")
    if fs.exists(manifest) and spark.read.text(f"{path}.manifest").first()[0] == mark:
        return spark.read.parquet(path)
    fs.delete(manifest, True)
    build().write.mode("overwrite").parquet(path)
    spark.createDataFrame([(mark,)], "value string").coalesce(1).write.text(f"{path}.manifest")
    return spark.read.parquet(path)


def content(df: DataFrame) -> tuple:
    """Rows and the sum of their hashes: equal for tables of equal rows in any order, in one pass without a shuffle of rows."""
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first())


def publish(spark: SparkSession, path: str, inputs: list[str], build, parts: DataFrame | None = None) -> dict:
    """Build in a folder of this attempt, check, rename once; never overwrites. Returns the manifest, written beside `path`.

    Refuses an output that exists, is being published by another (path.lock) or lies in an input, inputs that change
    meanwhile, rows that do not come back equal (also those of a build that does not repeat), and, if `parts` lists the
    expected day and bucket pairs, a set of partitions that is not exactly that. A failed attempt leaves no output.
    """
    fs, target = _fs(spark, path)
    if any(path.rstrip("/").startswith(i.rstrip("/") + "/") or i.rstrip("/") == path.rstrip("/") for i in inputs):
        raise ValueError("the output lies in an input")
    lock = _fs(spark, f"{path}.lock")[1]
    try:
        fs.create(lock, False).close()
    except Exception as e:
        raise FileExistsError(f"{path} is being published: {path}.lock exists") from e
    staging = f"{path}.attempt-{uuid.uuid4().hex}"
    try:
        if fs.exists(target):
            raise FileExistsError(path)
        before = fingerprint(spark, *inputs)
        made = build()
        made.write.parquet(staging)
        back = spark.read.schema(made.schema).parquet(staging)
        rows = content(back)
        if content(build()) != rows:
            raise ValueError("the rows do not come back equal")
        if parts is not None:
            found = back.select("day", "bucket").distinct()
            if found.exceptAll(parts).limit(1).count() or parts.exceptAll(found).limit(1).count():
                raise ValueError("partitions are missing or unexpected")
        if fingerprint(spark, *inputs) != before:
            raise RuntimeError("an input changed during the build")
        files = [[r.path.rpartition("/")[2], r.bytes, r.sha256] for r in file_digests(spark, staging).where("path like '%.parquet'").orderBy("path").toLocalIterator()]
        manifest = {"inputs": before, "rows": rows[0], "hash": str(rows[1]), "files": files}
        if not fs.rename(_fs(spark, staging)[1], target):
            raise FileExistsError(path)
        write_document(spark, manifest, f"{path}.manifest")
        return manifest
    finally:
        fs.delete(_fs(spark, staging)[1], True)
        fs.delete(lock, False)


def verify_copy(spark: SparkSession, path: str, manifest: dict) -> bool:
    """Whether a copy of a published table holds the very files of its manifest, and so its rows."""
    found = [[r.path.rpartition("/")[2], r.bytes, r.sha256] for r in file_digests(spark, path).where("path like '%.parquet'").orderBy("path").toLocalIterator()]
    return sorted(found) == sorted(manifest["files"])


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return symmetric_difference(a, b).limit(1).count() == 0


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
