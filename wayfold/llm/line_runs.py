"""Operator 10: removal of repeated line runs, in DataFrame operations only.

The suffixes of the line-ID sequences are named by prefix doubling: the name of the 2k lines at a position is made from
the names of the k lines there and k lines on, so equal names are equal runs, and the positions of one name are an
interval of the suffix array whose common prefix is that long. (A name stands in for the rank: order between intervals
plays no part in what is deleted.) The first position of an interval stays; at each later one the run is a later copy.
Overlapping later copies add up to the maximal repeated runs, and their lines are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest lines of a run.
MIN_LINES = 2
#: op10_line_runs_long_lines also deletes later copies of single lines of more words.
LONG_WORDS = 50
_NULL_ID = -(1 << 63)


def _names(ids: Column, depth: int) -> Column:
    """Names of the runs of `depth` lines at each position of an array of names of single lines."""
    names, size = ids, 1
    while size < depth:
        step = min(size, depth - size)  # the last step overlaps where depth is no power of two
        names = _doubled(names, step)
        size += step
    return names


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _doubled(names: Column, step: int) -> Column:
    def pairs(v: Column) -> Column:
        starts = F.when(F.size(v) > step, F.sequence(F.lit(0), F.size(v) - 1 - step)).otherwise(F.array().cast("array<int>"))

        def pair(i: Column) -> Column:
            x, y = F.get(v, i), F.get(v, i + step)
            return F.struct(F.xxhash64(F.lit(1), x["a"], y["a"]).alias("a"), F.xxhash64(F.lit(2), x["b"], y["b"]).alias("b"))

        return F.transform(starts, pair)

    return _let(names, pairs)


def remove_repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_removed, n_runs): texts without later copies of runs of min_lines lines or more.

    With long_words, later copies of single lines of more than so many words (between blanks) go as well.

    Lines end at a line feed; blank lines belong to no run and stay. The earliest copy is that of the smallest doc_id,
    then the earliest line; a null id comes first. A null text stays null with 0 lines. Rows that repeat both id and
    text are one document; the same id with another text is a document of its own. n_runs counts maximal deleted runs of
    consecutive non-blank lines. Other columns are ignored.
    """
    base = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    base = base.withColumn("k", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))).withColumn("t", F.xxhash64("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    ids = F.transform(lines, lambda x: F.struct(F.xxhash64(F.lit(1), x).alias("a"), F.xxhash64(F.lit(2), x).alias("b")))
    if long_words is None:
        runs = base.where("text is not null").select("k", "t", ids.alias("ids")).select("k", "t", F.posexplode(_names(F.col("ids"), min_lines)).alias("i", "name"), F.lit(min_lines).alias("n"))
    else:
        long = F.transform(lines, lambda x: F.size(F.regexp_extract_all(x, F.lit("[^ ]+"), F.lit(0))) > long_words)
        zipped = base.where("text is not null").select("k", "t", ids.alias("ids"), long.alias("long")).withColumn("names", _names(F.col("ids"), min_lines))
        zipped = zipped.select("k", "t", F.posexplode(F.arrays_zip("names", "ids", "long")).alias("i", "x"))
        of = [F.struct(F.col("x.names").alias("name"), F.lit(min_lines).alias("n")), F.struct(F.when(F.col("x.long"), F.col("x.ids")).alias("name"), F.lit(1).alias("n"))]
        runs = zipped.select("k", "t", "i", F.inline(F.array(*of))).where("name is not null")
    # Aggregation before the shuffle; a very frequent run leaves one row per task.
    first = runs.groupBy("name").agg(F.min(F.struct("k", "t", "i")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    later = runs.join(first, "name").where(F.struct("k", "t", "i") > F.col("first")).select("k", "t", "i", "n").distinct()
    later = later.groupBy("k", "t").agg(F.array_sort(F.collect_list(F.struct("i", "n"))).alias("starts"))
    both = base.join(later, ["k", "t"], "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<struct<i: int, n: int>>")))
    both = both.withColumn("lines", F.split("text", "\n", -1))
    # Set operations on positions, all linear in the lines of a text.
    places = F.sequence(F.lit(0), F.size("lines") - 1)
    both = both.withColumn("full", F.coalesce(F.filter(places, lambda p: F.trim(F.get("lines", p)) != ""), F.array().cast("array<int>")))
    both = both.withColumn("gone", F.array_distinct(F.flatten(F.transform("starts", lambda x: F.sequence(x["i"], x["i"] + x["n"] - 1)))))
    lead = F.array_except("gone", F.transform("gone", lambda i: i + 1))
    stay = F.array_except(places, F.transform("gone", lambda i: F.get("full", i)))
    text = F.when(F.size("gone") == 0, F.col("text")).otherwise(F.array_join(F.transform(stay, lambda p: F.get("lines", p)), "\n"))
    return both.select("doc_id", text.alias("text"), F.size("full").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.size(lead).cast("long").alias("n_runs"))


def op10_line_runs(spark, sf_dir: str) -> DataFrame:
    """All of documents, runs of two lines or more."""
    return remove_repeated_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_line_runs_long_lines(spark, sf_dir: str) -> DataFrame:
    """All of documents, runs of two lines or more and single lines of more than LONG_WORDS words."""
    return remove_repeated_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), long_words=LONG_WORDS)


SQL = """
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents),
n AS (SELECT doc_id, p, line, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i FROM l WHERE trim(line, ' ') <> ''),
g AS (SELECT doc_id, i, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM n),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS r FROM g WHERE b IS NOT NULL),
x AS (SELECT DISTINCT doc_id, i + o AS i FROM f, (SELECT unnest([0, 1]) AS o) WHERE r > 1),
y AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (NOT EXISTS (SELECT 1 FROM x z WHERE z.doc_id = x.doc_id AND z.i = x.i - 1)) AS n_runs FROM x GROUP BY doc_id),
k AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS text FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.p = l.p
  LEFT JOIN x ON x.doc_id = n.doc_id AND x.i = n.i WHERE x.i IS NULL GROUP BY l.doc_id),
c AS (SELECT doc_id, count(*) AS n_lines FROM n GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN y USING (doc_id)
"""

_PAIRS = "x AS (SELECT DISTINCT doc_id, i + o AS i FROM f, (SELECT unnest([0, 1]) AS o) WHERE r > 1)"
_LONG = f"""o AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS r FROM n WHERE len(regexp_extract_all(line, '[^ ]+')) > {LONG_WORDS}),
x AS (SELECT doc_id, i + o AS i FROM f, (SELECT unnest([0, 1]) AS o) WHERE r > 1 UNION SELECT doc_id, i FROM o WHERE r > 1)"""
SQL_LONG = SQL.replace(_PAIRS, _LONG)
