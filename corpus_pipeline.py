"""The training-corpus pipeline: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import new_folder
from wayfold.llm.decontaminate import decontaminate
from wayfold.llm.language import UNKNOWN, fit, held_out, identify
from wayfold.llm.mixing import mix
from wayfold.llm.ngram_join import link_components
from wayfold.llm.wavelet import token_output


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null text or no letter) go; of the others `lang` becomes the language predicted.

    The model learns from the rows that are not held out. If no row teaches, every text is in no language and goes.
    Repeated rows and null ids are treated like any other; an empty table stays empty.
    """
    names = docs.columns
    model = fit(docs.where(~held_out()))
    return identify(docs, model).where(F.col("lang_pred") != UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at 0.75 or more the row of the smallest doc_id stays, once.

    Rows that share a doc_id but not the text are documents of their own. Rows of null id stay.
    """
    known = docs.where("doc_id is not null").withColumn("_key", F.col("doc_id").cast("long"))
    hashed = known.select("doc_id", F.xxhash64("text").alias("t"))
    repeated = hashed.groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select(F.col("doc_id").alias("_id"))
    if repeated.isEmpty():
        found = link_components(known)
        keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_key")).distinct()
    else:
        known = known.join(repeated, F.col("doc_id") == F.col("_id"), "left").withColumn("_key", F.when(F.col("_id").isNull(), F.col("_key")).otherwise(F.xxhash64("doc_id", "text"))).drop("_id")
        found = link_components(known.select(F.col("_key").alias("doc_id"), "text")).select(F.col("doc_id").alias("_key"), "component_id").distinct()
        of = known.select("_key", "doc_id").distinct().join(found, "_key")
        keep = of.groupBy("component_id").agg(F.min(F.struct("doc_id", "_key")).alias("x")).select("x._key")
    return known.join(keep, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns).union(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; rows of null id or text and clean rows that share an id stay."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: 0 to 3 equal rows.

    Rows are told apart by id, source and text; of rows equal in all three (the stages before leave none but of null id)
    each is used as often as the most used of them. A null source is a source; an empty table stays empty.
    """
    key = ["_id", "_t", "_s"]
    taken = mix(docs.withColumn("_t", F.xxhash64("text")), keep=("_t", "source"))
    uses = taken.groupBy(F.col("doc_id").alias("_id"), "_t", F.col("source").alias("_s")).agg(F.max("repeats").alias("_uses")).where("_uses > 0")
    rows = docs.join(uses, docs["doc_id"].eqNullSafe(uses["_id"]) & docs["source"].eqNullSafe(uses["_s"]) & (F.xxhash64(docs["text"]) == uses["_t"]))
    return rows.withColumn("_use", F.explode(F.sequence(F.lit(1), F.col("_uses").cast("int")))).drop(*key).select(*docs.columns)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in wavelet-matrix shards; what they hold per document, repeated rows as often as they occur."""
    return token_output(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", source_mix),
    ("token-ID / binary output", token_files),
]

#: Language identification and token output are not expressible in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_folder(spark, "pipeline-" + name.split()[0].strip(",/").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
