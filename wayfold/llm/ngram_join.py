"""Operator 3: N-gram Jaccard join by T-occurrence search with DivideSkip.

1. Every text becomes the set of 64-bit hashes of its distinct word shingles; equal sets are one class, and only
   the class representative (smallest doc_id) is compared further.
2. A fixed-size table counts all shingles of all texts by hash bucket. It orders shingles rare first, so that a
   passage shared by a third of all documents comes last. The order changes the work only, never the result.
3. With e(n) = n div 8 + 1, two linked sets share at least e(min(|x|, |y|)) of their first |x| - ceil(t |x|) + e(|x|)
   shingles in that order. Every such inverted list is led by its smallest document; documents sharing a list with
   the same leader form a group. A document with fewer than e(ceil(t |x|)) shingles in lists of two or more has no
   link and travels nowhere; every linked pair meets in at least one group, and a document travels to a group once.
4. Groups larger than a block are cut into blocks by set size, and pairs of blocks are compared.
5. In a block pair, inverted lists over the whole sets are searched: for a query needing T common shingles, the L
   longest lists are put aside, the others are merged and counted, documents reaching T - L stay, and these are
   looked up in the long lists by binary search. Documents reaching the exact overlap are linked.
6. Links become spanning edges per block pair, and edges become components by star contraction.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, byte_view, new_folder, open_fs, publish, shingle_sets, slices, text_column, written
from .components import components

#: Counters of the shingle order: a fixed 16 MB table whatever the input.
COUNTER_BITS = 22
#: Shingles in one block of a group.
BLOCK_SHINGLES = 1_000_000
#: The prefix is longer by 1/EXTRA of the set, and as many shared shingles are asked for.
EXTRA = 8
#: Partial tables that one task adds up.
FAN_IN = 64
#: Block pairs and documents (some 40 bytes each) up to which they are broadcast to the texts.
BROADCAST_UNITS = 500_000
#: Factor of DivideSkip's number of long lists: L = T / (mu log2(longest) + 1).
MU = 0.02


def _sets(batch: pa.RecordBatch, width: int):
    column = text_column(batch, "text")
    data, offsets = byte_view(column)
    for a, b in slices(offsets):
        yield a, b, shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, d1, d2): size and 128-bit digest of each document's shingle set."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, sets in _sets(batch, width):
                n = np.array([len(s) for s in sets], np.int64)
                d1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
                d2 = np.array([np.bitwise_xor.reduce(s * (s >> np.uint64(7) | np.uint64(1))) for s in sets], np.uint64)
                yield pa.record_batch([ids.slice(a, b - a), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))], ["doc_id", "n_shingles", "d1", "d2"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long")


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def shingle_counts(docs: DataFrame, width: int = 5) -> str:
    """Count the shingles of all documents by hash bucket; write the table to the shared folder and return its path.

    Each task sends one compressed partial table in 16 slices; partial tables are added up in levels of FAN_IN.
    """
    import zstandard

    parts = 16
    size = 1 << COUNTER_BITS

    def count(batches):
        total = None
        for batch in batches:
            for _, _, sets in _sets(batch, width):
                if total is None:
                    total = np.zeros(size, np.int64)
                total += np.bincount(_bucket(np.concatenate(sets)), minlength=size) if sets else 0
        if total is not None:
            from pyspark import TaskContext

            yield _tables(total.reshape(parts, -1), range(parts), TaskContext.get().partitionId())

    def _tables(rows, which, task):
        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.record_batch([pa.array(list(which), pa.int32()), pa.array([task] * len(rows), pa.int32()), pa.array([pack(np.ascontiguousarray(r).tobytes()) for r in rows], pa.binary())], ["slice", "task", "counts"])

    def add(batches):
        total, key = None, None
        for batch in batches:
            for s, t, c in zip(*(batch.column(k).to_pylist() for k in ("slice", "task", "counts")), strict=True):
                part = np.frombuffer(zstandard.decompress(c), np.int64)
                if (s, t) != key and key is not None:
                    yield _tables([total], [key[0]], key[1])
                    total = None
                key = (s, t)
                total = part.copy() if total is None else total + part
        if key is not None:
            yield _tables([total], [key[0]], key[1])

    schema = "slice int, task int, counts binary"
    n = docs.rdd.getNumPartitions()
    partial = docs.select("text").mapInArrow(count, schema)
    while True:
        n = ceil(n / FAN_IN)
        partial = partial.withColumn("task", F.expr(f"cast(task div {FAN_IN} as int)")).repartition("slice", "task").sortWithinPartitions("slice", "task").mapInArrow(add, schema)
        if n <= 1:
            break
    rows = {r.slice: np.frombuffer(zstandard.decompress(bytes(r.counts)), np.int64) for r in partial.collect()}  # 16 rows, 32 MB at most
    table = np.concatenate([rows.get(k, np.zeros(size // parts, np.int64)) for k in range(parts)])
    path = new_folder(docs.sparkSession, "shingle-counts") + "/counts.bin"
    publish(path, np.minimum(table, 2**32 - 1).astype(np.uint32).tobytes())
    return path


_LOADED: dict[str, np.ndarray] = {}


def _counts(path: str) -> np.ndarray:
    if path not in _LOADED:
        _LOADED.clear()
        fs, p = open_fs(path)
        with fs.open_input_file(p) as f:
            _LOADED[path] = np.frombuffer(f.read(), np.uint32)
    return _LOADED[path]


def prefix_tokens(docs: DataFrame, counts: str, percent: int, width: int = 5) -> DataFrame:
    """(token, doc_id): the rarest |x| - ceil(t |x|) + e(|x|) shingles of each document."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for a, b, sets in _sets(batch, width):
                table, out, owner = _counts(counts), [], []
                for k, s in enumerate(sets):
                    if not len(s):
                        continue
                    keep = min(len(s), len(s) - -(-percent * len(s) // 100) + len(s) // EXTRA + 1)
                    order = np.lexsort((s, table[_bucket(s)]))[:keep]
                    out.append(s[order])
                    owner.append(np.full(keep, ids[a + k]))
                if out:
                    yield pa.record_batch([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.concatenate(owner).astype(np.int64))], ["token", "doc_id"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "token long, doc_id long")


class Forest:
    def __init__(self, n: int):
        self.up, self.trees = list(range(n)), n

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.trees -= 1
        return x != y


def t_occurrence(sets: list[np.ndarray], queries, percent: int, forest: Forest, targets: range) -> None:
    """Join in `forest` each query with every target whose overlap reaches percent of the union.

    Queries and targets are positions in `sets`, which is sorted by set size. Stops early once all are one tree.
    """
    lengths = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate([sets[t] for t in targets]), np.repeat(np.arange(targets.start, targets.stop), lengths[targets.start : targets.stop])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    key = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]]) if len(tokens) else np.zeros(0, np.int64)
    ends, keys = np.r_[key[1:], len(tokens)], tokens[key] if len(tokens) else tokens
    for q in queries:
        if forest.trees == 1:
            return
        x = sets[q]
        at = np.searchsorted(keys, x)
        at[at == len(keys)] = 0
        at = at[keys[at] == x] if len(keys) else at[:0]
        need = -(-percent * len(x) // 100)  # the least overlap with any partner no larger; a larger one needs more
        small = np.searchsorted(lengths, need)  # partners of fewer shingles cannot reach it
        if len(at) < need:
            continue
        first, last = key[at], ends[at]
        width = last - first
        by = np.argsort(width, kind="stable")
        long = min(int(need / (MU * log2(max(2, int(width[by[-1]]))) + 1)), need - 1, len(at) - 1)
        cut = len(by) - long
        short, far = by[:cut], by[cut:]
        # Merge the short lists and count.
        total = int(width[short].sum())
        jump = np.repeat(first[short] - np.r_[0, np.cumsum(width[short])[:-1]], width[short]) + np.arange(total)
        seen = np.bincount(owner[jump], minlength=len(sets))
        found = np.flatnonzero(seen >= need - long)
        found = found[(found >= small) & (found != q)]
        root = forest.find(q)
        found = np.array([y for y in found.tolist() if forest.find(y) != root], np.int64)
        if not len(found):
            continue
        overlap = seen[found]
        # Look the survivors up in the long lists by binary search; drop those that can no longer reach the overlap.
        least = -(-percent * (len(x) + lengths[found]) // (100 + percent))
        for left, k in zip(range(len(far) - 1, -1, -1), far.tolist(), strict=True):
            members = owner[first[k] : last[k]]
            spot = np.searchsorted(members, found)
            spot[spot == len(members)] = 0
            overlap = overlap + (members[spot] == found)
            keep = overlap + left >= least
            if not keep.all():
                found, overlap, least = found[keep], overlap[keep], least[keep]
                if not len(found):
                    break
        for y in found[(100 + percent) * overlap >= percent * (len(x) + lengths[found])].tolist():
            forest.join(q, y)


def _unit_edges(rows: list[tuple], percent: int):
    """Spanning edges of one block pair; rows are (side, doc_id, set)."""
    rows.sort(key=lambda r: (r[0], len(r[2]), r[1]))
    two = rows[-1][0] != rows[0][0]
    ids = [r[1] for r in rows]
    if two:
        rest = sum(r[0] == rows[0][0] for r in rows)
        low, high = rows[:rest], rows[rest:]
        sizes = [len(r[2]) for r in low], [len(r[2]) for r in high]
        if 100 * sizes[0][-1] < percent * sizes[1][0] or 100 * sizes[1][-1] < percent * sizes[0][0]:
            return []
        rows = sorted(rows, key=lambda r: (len(r[2]), r[1]))
        ids = [r[1] for r in rows]
    sets = [r[2] for r in rows]
    forest = Forest(len(rows))
    if len(rows) > 1:
        # The most central size first: in a group of near copies one query then links most of it.
        start = len(rows) // 2
        t_occurrence(sets, [*range(start, len(rows)), *range(start - 1, -1, -1)], percent, forest, range(len(rows)))
    heads: dict[int, int] = {}
    for k in range(len(rows)):
        r = forest.find(k)
        heads[r] = min(heads.get(r, ids[k]), ids[k])
    return [(ids[k], heads[forest.find(k)]) for k in range(len(rows)) if heads[forest.find(k)] != ids[k]]


def link_components(docs: DataFrame, percent: int = 75, width: int = 5, block: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text, ...).

    Two documents link when 100 * |x & y| >= percent * |x | y| on distinct shingles of `width` words (A-Z folded,
    words [^\\x20\\x09-\\x0D]+); with fewer words the whole sequence is one shingle. component_id is the smallest
    doc_id reachable by links. Null, empty and blank texts have n_shingles 0 and are their own component. Rows with a
    null doc_id get a null component_id and link with nothing. Repeated rows are each returned; a repeated doc_id
    stands for one document in the links. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = written(signatures(docs, width), "signatures")
    classes = sig.where("n_shingles > 0 and doc_id is not null").groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")
    counts = shingle_counts(docs, width)
    lists = Window.partitionBy("token")
    led = (
        prefix_tokens(docs, counts, percent, width)
        .select("doc_id", F.min("doc_id").over(lists).alias("leader"), F.count("*").over(lists).alias("documents"))
        .where("documents > 1")
        .groupBy("leader", "doc_id")
        .agg(F.count("*").alias("shared"))
    )
    reps = classes.select(F.col("rep").alias("doc_id"), F.col("d1"), F.col("n_shingles").alias("n"))
    members = (
        led.join(reps, "doc_id")
        .withColumn("shared", F.sum("shared").over(Window.partitionBy("doc_id")))
        .where(f"shared >= (({percent} * n + 99) div 100) div {EXTRA} + 1")
        .select("leader", "doc_id", "n", "d1")
    )
    members = written(members, "members")
    # Blocks follow set size: a size's share of the running sum is dealt to its documents by hash, so no task orders a group.
    by_size = members.groupBy("leader", "n").agg(F.count("*").alias("c"))
    sizes = Window.partitionBy("leader")
    running = F.coalesce(F.sum(F.col("c") * F.col("n")).over(sizes.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_size = by_size.select("leader", "n", "c", running.alias("before"), F.sum("c").over(sizes).alias("members"), F.sum(F.col("c") * F.col("n")).over(sizes).alias("total"))
    members = members.join(by_size.where("members > 1"), ["leader", "n"]).select(
        "leader", "doc_id", "d1", F.expr(f"(before + pmod(xxhash64(doc_id), c) * n) div {block}").alias("block"), F.expr(f"(total - 1) div {block}").alias("blocks")
    )
    units = members.select("doc_id", "d1", "leader", "block", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int"))).alias("other"))
    units = units.groupBy("doc_id", "d1").agg(
        F.collect_list(F.struct("leader", F.least("block", F.col("other").cast("long")).alias("i"), F.greatest("block", F.col("other").cast("long")).alias("j"), "block")).alias("units")
    )
    units = written(units, "units")
    # Where few documents have a partner to be compared with, they are sent to the texts; else the texts are shuffled to them.
    if units.agg(F.coalesce(F.sum(F.size("units") + 1), F.lit(0))).first()[0] <= BROADCAST_UNITS:
        units = F.broadcast(units)

    def expand(batches):
        for batch in batches:
            ids, digest, lists = (batch.column(k).to_pylist() for k in ("doc_id", "d1", "units"))
            for a, _, sets in _sets(batch, width):
                rows: list[tuple] = []
                held = 0
                for k, s in enumerate(sets, a):
                    if s.sum(dtype=np.uint64).astype(np.int64) != digest[k]:
                        continue  # another text under the same doc_id
                    data = s.tobytes()
                    for u in lists[k]:
                        rows.append((u["leader"], u["i"], u["j"], u["block"], ids[k], data))
                        held += len(data)
                    if held > 8 << 20:
                        yield _rows(rows)
                        rows, held = [], 0
                if rows:
                    yield _rows(rows)

    names = ["leader", "i", "j", "block", "doc_id", "shingles"]

    def _rows(rows):
        return pa.record_batch([pa.array(c, pa.binary() if n == "shingles" else pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names)

    def search(batches):
        key, held, edges = None, [], []
        for batch in batches:
            columns = [batch.column(n) for n in names]
            numbers = [c.to_numpy(zero_copy_only=False) for c in columns[:5]]
            for k in range(batch.num_rows):
                now = (numbers[0][k], numbers[1][k], numbers[2][k])
                if now != key:
                    if len(held) > 1:
                        edges += _unit_edges(held, percent)
                    key, held = now, []
                held.append((int(numbers[3][k]), int(numbers[4][k]), np.frombuffer(columns[5][k].as_py(), np.uint64)))
            if edges:
                yield _edges(edges)
                edges = []
        if len(held) > 1 and (edges := _unit_edges(held, percent)):
            yield _edges(edges)

    def _edges(edges):
        return pa.record_batch([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["u", "v"])

    sets = docs.join(units, "doc_id").mapInArrow(expand, "leader long, i long, j long, block long, doc_id long, shingles binary")
    found = sets.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j").mapInArrow(search, "u long, v long")
    roots = components(found).withColumnRenamed("root", "component")
    classes = classes.join(roots, classes.rep == roots.node, "left").select("d1", "d2", "n_shingles", F.coalesce("component", "rep").alias("component"))
    out = sig.join(classes, ["d1", "d2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All of documents: 5-word shingles, similarity 0.75."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
r AS (SELECT x AS node, x AS root FROM e UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id
"""
