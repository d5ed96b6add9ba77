"""Operator 6: mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). Token capacity flows from patterns
to source quotas; the r-th use of a pattern's tokens costs r, so repetition is convex. The flow of a pattern becomes
whole passes over its documents and a rest, which goes to documents in a seeded order until it is used up.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Most times that a document may be used.
REPEATS = 3
#: Membership patterns that the driver may hold and route (the flow's time grows with their square); sets of names, not of documents.
MOST_PATTERNS = 10_000
SEED = "mix"
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[int], repeats: int = REPEATS) -> list[float]:
    """Share sum(sizes) by weight; a target stops at repeats * size and the excess is shared again by weight."""
    total, out = sum(sizes), [0.0] * len(sizes)
    free = set(range(len(sizes)))
    while free:
        left, weight = total - sum(repeats * sizes[k] for k in range(len(sizes)) if k not in free), sum(weights[k] for k in free)
        over = {k for k in free if left * weights[k] > repeats * sizes[k] * weight}
        if not over:
            for k in free:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = float(repeats * sizes[k])
        free -= over
    return out


def min_cost_flow(capacity: list[int], members: list[list[int]], quotas: list[int], repeats: int = REPEATS) -> dict[tuple[int, int], int]:
    """Cheapest flow {(pattern, source): tokens} that fills the quotas as far as can be.

    Successive shortest paths with potentials over start -> pattern (one arc of cost r for the r-th use) -> its sources
    -> end. Each augmentation fills an arc, so their number depends on patterns and sources, not on tokens.
    """
    p, q = len(capacity), len(quotas)
    start, end = p + q, p + q + 1
    to, left, cost, arcs = [], [], [], [[] for _ in range(p + q + 2)]

    def arc(a, b, c, w):
        for x, y, cc, ww in ((a, b, c, w), (b, a, 0, -w)):
            arcs[x].append(len(to))
            to.append(y)
            left.append(cc)
            cost.append(ww)

    for k, c in enumerate(capacity):
        for r in range(1, repeats + 1):
            arc(start, k, c, r)
    first = len(to)
    for k, sources in enumerate(members):
        for s in sources:
            arc(k, p + s, repeats * capacity[k], 0)
    last = len(to)
    for s, c in enumerate(quotas):
        arc(p + s, end, c, 0)
    height = [0] * (p + q + 2)
    while True:
        far, via = {start: 0}, {}
        heap = [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for a in arcs[x]:
                if left[a] > 0 and (e := d + cost[a] + height[x] - height[to[a]]) < far.get(to[a], 1 << 60):
                    far[to[a]], via[to[a]] = e, a
                    heapq.heappush(heap, (e, to[a]))
        if end not in far:
            break
        for x in range(len(height)):
            height[x] += min(far.get(x, far[end]), far[end])
        amount, x = 1 << 62, end
        while x != start:
            amount, x = min(amount, left[via[x]]), to[via[x] ^ 1]
        x = end
        while x != start:
            left[via[x]] -= amount
            left[via[x] ^ 1] += amount
            x = to[via[x] ^ 1]
    return {(to[a ^ 1], to[a] - p): left[a ^ 1] for a in range(first, last, 2) if left[a ^ 1]}


def mix(docs: DataFrame, sources: str = "source", seed: str = SEED, repeats: int = REPEATS, weights=(1, 2, 3), keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, <sources>) with size, source_size, target, taken and repeats for every row.

    `sources` is a string column (one source each, null is a source) or an array of them (overlapping sources; null or
    empty is the source null). Sources in code point order, null last, get `weights` in turn. size is the number of
    words (null text: 0). taken is a whole multiple of size, at most `repeats` times it, chosen in the order of
    md5(seed|doc_id|text), so reruns agree. Null and repeated ids are told apart by their texts; of rows equal in both it
    does not matter which are taken, and each is counted on its own. For overlapping sources
    source_size and target are the sums over the document's sources. An empty table gives no rows. The column `pattern`
    is added, and the columns named in `keep` come along; other columns are ignored.
    """
    many = docs.schema[sources].dataType.typeName() == "array"
    names = F.col(sources) if many else F.array(F.col(sources).cast("string"))
    if many:
        names = F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.array_sort(F.array_distinct(names))).otherwise(F.array(F.lit(None).cast("string")))
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id"), *[F.col(c) for c in keep], size.alias("size"), names.alias("pattern"), F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("rank"))
    rows = written(rows.withColumn("slot", F.substring("rank", 1, 3)), "mix-sizes")
    slots = rows.groupBy("pattern", "slot").agg(F.sum("size").alias("slot_size"))
    totals = slots.groupBy("pattern").agg(F.sum("slot_size").alias("pattern_size")).take(MOST_PATTERNS + 1)
    if len(totals) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} membership patterns")
    totals = sorted(totals, key=lambda r: [(x is None, x or "") for x in r.pattern])
    order = sorted({x for r in totals for x in r.pattern}, key=lambda x: (x is None, x or ""))
    place = {x: k for k, x in enumerate(order)}
    sizes = [0] * len(order)
    for r in totals:
        for x in r.pattern:
            sizes[place[x]] += r.pattern_size
    goal = targets(sizes, [weights[k % len(weights)] for k in range(len(order))], repeats)
    members = [[place[x] for x in r.pattern] for r in totals]
    flow = min_cost_flow([r.pattern_size for r in totals], members, [round(g) for g in goal], repeats)
    sent = [0] * len(totals)
    for (k, _), v in flow.items():
        sent[k] += v
    plan = [(r.pattern, sum(sizes[s] for s in m), float(sum(goal[s] for s in m)), *(divmod(v, r.pattern_size) if r.pattern_size else (0, 0))) for r, m, v in zip(totals, members, sent, strict=True)]
    plan = docs.sparkSession.createDataFrame(plan, "pattern array<string>, source_size long, target double, passes long, rest long")
    key = F.to_json("pattern")
    slots = slots.withColumn("before", F.coalesce(F.sum("slot_size").over(Window.partitionBy("pattern").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    slots = slots.withColumn("key", key).join(F.broadcast(plan.withColumn("key", key).drop("pattern")) if len(totals) < 10_000 else plan.withColumn("key", key).drop("pattern"), "key")
    # A slot holds about 1/4096 of a pattern, so even a third of all rows is dealt out; order within a slot is by rank.
    upto = F.sum("size").over(Window.partitionBy("key", "slot").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("key", key).join(slots.drop("pattern"), ["key", "slot"])
    used = F.col("passes") + F.when(2 * (F.col("before") + upto) - F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)
    rows = rows.withColumn("repeats", F.least(used, F.lit(repeats)).cast("long"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("repeats") * F.col("size")).alias("taken"), "repeats", "pattern", *keep)


def op6_source_mix(spark, sf_dir: str) -> DataFrame:
    """All of documents by source."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("repeats", "pattern")


SQL = """
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
    md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS rank FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(3 * n) OVER a, 0) AS used, (sum(w) OVER ()) - coalesce(sum(w) OVER a, 0) AS wl, sum(n) OVER () AS total
  FROM s WINDOW a AS (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (total - used) * w > 3 * n * wl AS over FROM o),
l AS (SELECT total - coalesce(sum(3 * n) FILTER (over), 0) AS rem, sum(w) FILTER (NOT over) AS wt FROM c GROUP BY total),
t AS (SELECT source, n, CASE WHEN over THEN (3 * n)::DOUBLE ELSE (rem * w)::DOUBLE / wt::DOUBLE END AS target FROM c, l),
f AS (SELECT d.*, t.n, t.target, round_even(t.target, 0)::BIGINT AS q, sum(size) OVER (PARTITION BY d.source ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target,
  CASE WHEN n = 0 THEN 0 ELSE size * least(3, q // n + CASE WHEN 2 * upto - size <= 2 * (q % n) THEN 1 ELSE 0 END) END::BIGINT AS taken
FROM f
"""
