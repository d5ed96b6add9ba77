"""Operator 8: benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Each mask selects some of up to WINDOW consecutive words and ignores the others, so a hit survives substituted words at
ignored places. Seeds of documents are joined to seeds of benchmark items; about every hit the aligned words are
compared, and a document is contaminated by an item if WINDOW aligned words hold at least MATCHES equal ones. The masks
of SEEDS are lossless for that rule: wherever WINDOW - MATCHES words of WINDOW differ, one of the masks fits between.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 1: the word counts, 0: it is ignored. Every placement of 3 differing words in 13 leaves room for one of these (found by
#: greedy search over weight 5).
SEEDS = ("111011", "1100001011", "101010011")
WINDOW = 13
MATCHES = 10
#: Items of fewer than WINDOW words must occur whole; those of fewer than this take no part.
BRIEF = 8
#: Words of a piece of a text; seeds start in it, and window - 1 words more on either side let a hit be verified.
PIECE = 32
#: Benchmark seeds (16 bytes each) up to which they and the items are broadcast; more are joined by a shuffle.
BROADCAST_SEEDS = 250_000


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _seeds(hashes: Column, masks, first: Column | None = None, most: int | None = None) -> Column:
    """array<struct<seed, pos>> of all masks over an array of word hashes; pos from `first` on, at most `most` of them."""
    first = F.lit(0) if first is None else first

    def of(k: int, mask: str) -> Column:
        span, picks = len(mask), [j for j, c in enumerate(mask) if c == "1"]
        last = F.size(hashes) - span if most is None else F.least(F.size(hashes) - span, first + (most - 1))
        starts = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.xxhash64(F.lit(k), *[F.get(hashes, i + j) for j in picks]).alias("seed"), i.alias("pos")))

    return F.concat(*[of(k, mask) for k, mask in enumerate(masks)])


def _pieces(w: Column, window: int) -> Column:
    """The words in pieces of PIECE, each with the window - 1 words before and after it."""
    lead = window - 1
    numbers = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.floor((F.size(w) - 1) / PIECE).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(numbers, lambda c: F.slice(w, F.greatest(c * PIECE - lead, F.lit(0)) + 1, F.least(c * PIECE, F.lit(lead)) + PIECE + lead))


def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, masks=SEEDS, window: int = WINDOW, matches: int = MATCHES) -> DataFrame:
    """(doc_id, t, item_id, best): pairs whose aligned words match in `matches` of `window`, with the best count in a window.

    t is the hash of the text, so that rows that share an id but not the text are told apart; repeated rows give one row
    per pair. An item of fewer than `window` words must occur whole; items of fewer than BRIEF words, null ids and null or
    empty texts take no part. Other columns are ignored; an empty table gives no pairs. Pairs are whole, as the masks fit
    every `window - matches` differing words.
    """
    d = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("t"), F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    pieces = d.select("doc_id", "t", F.posexplode(_pieces(F.col("w"), window)).alias("c", "w"))
    b = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("v")).where(F.size("v") >= BRIEF)
    bench_seeds = b.select("item_id", F.inline(_seeds(F.col("v"), masks))).select("item_id", "seed", F.col("pos").alias("at"))
    found = _seeds(F.col("w"), masks, F.least(F.col("c") * PIECE, F.lit(window - 1)), PIECE)
    if bench_seeds.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        # A hit is verified where it is found: no text is shuffled. The items have fewer words than seeds.
        paired = pieces.select("doc_id", "t", "w", F.inline(found)).join(F.broadcast(bench_seeds), "seed").join(F.broadcast(b), "item_id")
    else:
        hits = pieces.select("doc_id", "t", "c", F.inline(found)).join(bench_seeds, "seed").drop("seed").distinct()
        paired = hits.join(pieces.distinct(), ["doc_id", "t", "c"]).join(b, "item_id")
    # Any window that holds `matches` equal words holds a hit, so only the windows about each hit are counted.
    low = F.greatest(F.col("at") - (window - 1), F.lit(0))
    high = F.greatest(F.least(F.col("at"), F.size("v") - window), F.lit(0))
    same = F.transform(F.sequence(low, F.least(F.col("at") + (window - 1), F.size("v") - 1)), lambda i: F.when(F.get("w", i - F.col("at") + F.col("pos")) == F.get("v", i), 1).otherwise(0))
    best = F.array_max(F.transform(F.sequence(F.lit(1), F.col("high") - F.col("low") + 1), lambda s: F.aggregate(F.slice("same", s, window), F.lit(0), lambda a, x: a + x)))
    need = F.when(F.size("v") < window, F.size("v")).otherwise(matches)
    paired = paired.select("doc_id", "t", "item_id", need.alias("need"), low.alias("low"), high.alias("high"), same.alias("same"))
    paired = paired.select("doc_id", "t", "item_id", "need", best.alias("best"))
    return paired.where("best >= need").groupBy("doc_id", "t", "item_id").agg(F.max("best").cast("long").alias("best"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that no benchmark item contaminates, with all their columns; repeated rows alike. Rows of null id or text stay."""
    bad = contaminated_pairs(docs, benchmark, **options).select("doc_id", "t").distinct()
    return docs.join(bad, (docs["doc_id"] == bad["doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["t"]), "left_anti")


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    """All of documents against all of benchmark: doc_id, contaminated, n_items, first_item, best."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pairs = contaminated_pairs(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = pairs.groupBy("doc_id", "t").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("best").alias("best"))
    return docs.select("doc_id", text_key().alias("t")).join(found, ["doc_id", "t"], "left").select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), "first_item", "best")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
#: Without seeds: every diagonal on which a document and an item have words in common.
SQL = f"""
WITH d AS (SELECT doc_id, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS i FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
b AS (SELECT item_id, len({_WORDS}) AS n, unnest({_WORDS}) AS w, generate_subscripts({_WORDS}, 1) AS j FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
e AS (SELECT doc_id, item_id, n, i - j AS shift, list(j) AS js FROM d JOIN b USING (w) WHERE n >= {BRIEF} GROUP BY 1, 2, 3, 4 HAVING count(*) >= least(n, {MATCHES})),
p AS (SELECT doc_id, item_id, n, max(list_max(list_transform(range(1, greatest(n - {WINDOW} + 1, 1) + 1), lambda s: len(list_filter(js, lambda j: j >= s AND j < s + {WINDOW}))))) AS best FROM e GROUP BY 1, 2, 3),
f AS (SELECT doc_id, count(*) AS n_items, min(item_id) AS first_item, max(best)::BIGINT AS best FROM p WHERE best >= CASE WHEN n < {WINDOW} THEN n ELSE {MATCHES} END GROUP BY 1)
SELECT d.doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, first_item, best FROM documents d LEFT JOIN f ON d.doc_id = f.doc_id
"""
