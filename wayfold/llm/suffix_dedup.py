"""Operator 9: removal of long repeated byte strings by a logarithmic family of suffix arrays.

1. Equal texts are one text with a count of copies; copied texts repeat whole.
2. Every window of `short` bytes has an anchor: the place of its smallest hashed gram. Equal windows have equal anchors
   at equal offsets, so they meet under the anchor's gram. Consecutive windows with one gram make a region (a periodic
   passage is one region, however long); there are about 2 regions for each `short` bytes. The distinct regions of a
   batch of texts, in the order of their grams, are the batch's level in the index family.
3. A new batch is merge-scanned against every level on the gram. A region that occurs twice repeats whole and needs no
   search. Of the others only those whose gram has more than one distinct region, or that are periodic, are searched,
   one copy of each. Levels of equal size merge, so an entry is rewritten a logarithmic number of times.
4. The asked regions are dealt by gram. The regions of a gram, which all hold it at a known place, get two suffix arrays
   in byte order with their longest common prefixes: one of what follows from the gram on, one of what precedes it read
   backwards. Walking the first array's prefix intervals from deep to shallow while keeping each interval's members in
   the order of the second finds, for every region, all maximal pairs of common extensions; a window within one repeats.
   A periodic region is first split at its anchors, and equal splits are one. Windows of a gram with very many regions
   are dealt by fingerprint instead, copies within a task combined first.
5. Bytes of windows that repeat in `length` bytes are removed; a repeat of `short` bytes is reported only.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Rolling, byte_view, mix, new_folder, open_fs, publish, slices, text_column, write_table

#: Bytes of a removed string; bytes of a string that is reported (nearly all passages of over 50 words are as long); of a gram.
LENGTH, SHORT, GRAM = 400, 300, 32
#: Bytes of one text that one call works on, about; longer texts are worked on in overlapping parts.
PART = 1 << 20
#: Bytes of regions searched at a time; windows in one task, about; regions of a gram beyond which its windows are dealt by fingerprint.
BATCH, TASK, HOT = 8 << 20, 4 << 20, 100_000
#: A region in one number: first << 32 | anchor - first << 23 | last - first << 1 | periodic.
_FIRST, _OFFSET, _WIDTH = 32, 23, 1
_WIDTHS, _OFFSETS = (1 << 22) - 1, (1 << 9) - 1
_PLACE = np.uint64((1 << 30) - 1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by prefix and suffix minima of blocks of w."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    blocks = pad.reshape(-1, w)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[: n - w + 1], before[w - 1 : n])


def regions(data: np.ndarray, offsets: np.ndarray, length: int, short: int, gram: int, own: tuple[int, int] | None = None):
    """(text, first, last, anchor, periodic, gram hash, region hash) of all regions of windows, or of those with an anchor in the range `own`."""
    n = len(data)
    if n < short:
        z = np.zeros(0, np.int64)
        return z, z, z, z, z.astype(bool), z.astype(np.uint64), z.astype(np.uint64)
    roll = Rolling(data)
    at = np.arange(n - gram + 1)
    hashes = roll.ranges(at, at + gram)
    anchor = (_sliding_min(hashes & ~_PLACE | at.astype(np.uint64), short - gram + 1) & _PLACE).astype(np.int64)
    end = np.repeat(offsets[1:], np.diff(offsets))
    start = np.flatnonzero(at[: len(anchor)] + short <= end[: len(anchor)])
    anchor = anchor[start]
    if own is not None:
        mine = (anchor >= own[0]) & (anchor < own[1])
        start, anchor = start[mine], anchor[mine]
    key = hashes[anchor]
    new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (start[1:] != start[:-1] + 1)]) if len(start) else start
    stop = np.r_[new[1:], len(start)] - 1 if len(start) else start
    first, last = start[new], start[stop]
    until = np.minimum(last + length, end[first])
    body = roll.ranges(first, until)
    body = mix(body ^ ((until - first).astype(np.uint64) << np.uint64(32)) ^ (last - first).astype(np.uint64))
    return np.searchsorted(offsets, first, "right") - 1, first, last, anchor[new], anchor[new] != anchor[stop], key[new], body


def _common(roll: Rolling, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Length of the longest common prefix (back: suffix) of what starts (ends) at x and y, at most `most`, by bisection on hashes."""
    low, high = np.zeros(len(x), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        if back:
            same = roll.ranges(x - mid, x) == roll.ranges(y - mid, y)
        else:
            same = roll.ranges(x, x + mid) == roll.ranges(y, y + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _least(values: list[int]):
    """A function (a, b) -> min(values[a:b])."""
    if len(values) < 64:
        return lambda a, b: min(values[a:b])
    table = [np.array(values)]
    while 2 << len(table) - 1 <= len(values):
        half = 1 << len(table) - 1
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def query(a: int, b: int) -> int:
        k = (b - a).bit_length() - 1
        return int(min(table[k][a], table[k][b - (1 << k)]))

    return query


def extensions(order: list[int], forward: list[int], back_order: list[int], backward: list[int]):
    """Yield (i, j, l, r): pairs of members with l bytes common before and r from the gram on.

    order is the suffix array of what follows, forward the common prefixes of its neighbours; back_order and backward
    are those of what precedes. For every pair (i, j) some pair (i, k) with no smaller l and r is yielded, and some (j, k).
    """
    m = len(order)
    if m == 2:
        yield order[0], order[1], backward[0], forward[0]
        return
    rank = [0] * m
    for k, i in enumerate(back_order):
        rank[i] = k
    least = _least(backward)
    up = list(range(m))
    members: list[list[int] | None] = [[rank[i]] for i in order]

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for k in sorted(range(m - 1), key=lambda k: -forward[k]):
        a, b = find(k), find(k + 1)
        small, large = members[a], members[b]
        if len(small) > len(large):
            small, large = large, small
        for x in small:
            p = bisect_left(large, x)
            if p:
                yield back_order[x], back_order[large[p - 1]], least(large[p - 1], x), forward[k]
            if p < len(large):
                yield back_order[x], back_order[large[p]], least(x, large[p]), forward[k]
        if len(small) < 8:
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
        up[b], members[a], members[b] = a, large, None


class Regions:
    """Regions of some grams: their bytes and where they come from; search() finds the windows that repeat among them."""

    def __init__(self, length: int, short: int, gram: int):
        self.length, self.short, self.gram = length, short, gram
        self.groups: list[list[int]] = []
        self.bodies: list[bytes] = []
        self.at: list[tuple[int, int, int, int]] = []  # text number, first, anchor - first, last - first
        self.texts: list[tuple[int, int]] = []
        self.marks: list[tuple[int, int, int]] = []  # text number, first, last; first -1: repeats in `short` bytes
        self.held, self.now = 0, None

    def add(self, key: int, t: int, u: int, first: int, offset: int, width: int, periodic: bool, body: bytes) -> None:
        """Add a region of a gram; regions of one gram follow one another."""
        if key != self.now:
            self.groups.append([])
            self.now = key
        self.texts.append((t, u))
        if periodic:
            self._split(len(self.texts) - 1, first, width, body)
        else:
            self._put(len(self.texts) - 1, first, offset, width, body)

    def _put(self, text: int, first: int, offset: int, width: int, body: bytes) -> None:
        self.groups[-1].append(len(self.bodies))
        self.bodies.append(body)
        self.at.append((text, first, offset, width))
        self.held += len(body) + 200

    def _split(self, text: int, first: int, width: int, body: bytes) -> None:
        data = np.frombuffer(body, np.uint8)
        roll = Rolling(data)
        at = np.arange(len(data) - self.gram + 1)
        anchor = (_sliding_min(roll.ranges(at, at + self.gram) & ~_PLACE | at.astype(np.uint64), self.short - self.gram + 1) & _PLACE).astype(np.int64)[: width + 1]
        new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[new[1:], width + 1] - 1
        until = np.minimum(last + self.length, len(data))
        prints = mix(roll.ranges(new, until) ^ ((until - new).astype(np.uint64) << np.uint64(32)) ^ (last - new).astype(np.uint64) ^ ((anchor[new] - new).astype(np.uint64) << np.uint64(50)))
        _, one, which, n = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        for k in np.flatnonzero(n[which] > 1).tolist():
            self._mark(text, first + int(new[k]), first + int(min(last[k], until[k] - self.length)))
        for k in np.sort(one).tolist():
            self._put(text, first + int(new[k]), int(anchor[new[k]] - new[k]), int(last[k] - new[k]), body[new[k] : until[k]])

    def _mark(self, text: int, first: int, last: int) -> None:
        self.marks.append((text, -1, -1))
        if first <= last:
            self.marks.append((text, first, last))

    def search(self) -> None:
        """Mark what repeats among the regions added since the last search, and forget them."""
        groups = [g for g in self.groups if len(g) > 1]
        if groups:
            base = np.r_[0, np.cumsum([len(b) for b in self.bodies])]
            roll = Rolling(np.frombuffer(b"".join(self.bodies), np.uint8))
            offset = np.array([x[2] for x in self.at])
            anchor, size = base[:-1] + offset, np.diff(base)
            ahead = [[sorted(range(len(g)), key=[self.bodies[i][self.at[i][2] :] for i in g].__getitem__) for g in groups]]
            ahead.append([sorted(range(len(g)), key=[self.bodies[i][: self.at[i][2]][::-1] for i in g].__getitem__) for g in groups])
            common = []
            for orders, back in zip(ahead, (False, True), strict=True):
                x = np.array([g[a] for g, o in zip(groups, orders, strict=True) for a in o[:-1]])
                y = np.array([g[a] for g, o in zip(groups, orders, strict=True) for a in o[1:]])
                most = np.minimum(offset[x], offset[y]) if back else np.minimum(size[x] - offset[x], size[y] - offset[y])
                common.append(_common(roll, anchor[x], anchor[y], most, back).tolist())
            a = 0
            for g, order, back_order in zip(groups, *ahead, strict=True):
                b = a + len(g) - 1
                self._group(g, extensions(order, common[0][a:b], back_order, common[1][a:b]))
                a = b
        self.groups, self.bodies, self.at, self.held, self.now = [], [], [], 0, None

    def _group(self, group: list[int], pairs) -> None:
        found: dict[int, set] = {}
        for i, j, before, after in pairs:
            if before + after < self.short:
                continue
            for k in (i, j):
                text, first, offset, width = self.at[group[k]]
                low = offset - before  # window starts, from the region's first
                if low > width:
                    continue
                mine = found.setdefault(group[k], set())
                mine.add((-1, -1))
                if (high := min(width, offset + after - self.length)) >= low:
                    mine.add((first + low, first + high))
        for k, mine in found.items():
            self.marks += [(self.at[k][0], a, b) for a, b in _joined(mine)]


def _joined(ranges: set) -> list[tuple[int, int]]:
    """Ranges (first, last) in order, touching ones as one; (-1, -1) stays."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and out[-1][0] >= 0 and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


_KEYS = ["t", "u"]
_PIECE = "kind int, part int, gram long, t long, u long, span long, data binary, at binary"
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _unpack(span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, anchor - first, last - first, periodic) of packed regions."""
    return span >> _FIRST, span >> _OFFSET & _OFFSETS, span >> _WIDTH & _WIDTHS, (span & 1).astype(bool)


class IndexFamily:
    """A family of index levels in the shared folder, to which batches of texts are added one after another.

    A level is a table of texts(t, u, copies, text), t and u being hashes of the text, and one of entries(gram, region, n,
    t, u, span, periodic): the distinct regions in runs ordered by gram. `folder` names the family: a new one if None; an
    existing one is opened again, in this or a later session. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, length: int = LENGTH, short: int = SHORT, gram: int = GRAM, hot: int = HOT, part: int = PART, batch: int = BATCH):
        self.part, self.batch = part, batch
        self.spark, self.folder = spark, folder or new_folder(spark, "suffix-family")
        self.length, self.short, self.gram, self.hot = length, short, gram, hot
        fs, path = open_fs(f"{self.folder}/family.json")
        self.levels: list[dict] = []
        if folder and fs.get_file_info(path).is_file:
            with fs.open_input_file(path) as f:
                kept = json.loads(f.read())
            if kept["parameters"] != [length, short, gram]:
                raise ValueError(f"the family in {folder} has the parameters {kept['parameters']}")
            self.levels = kept["levels"]

    def _written(self, df: DataFrame, name: str) -> tuple[DataFrame, str]:
        path = new_folder(self.spark, name)
        write_table(df, path)
        return self.spark.read.schema(df.schema).parquet(path), path

    def _all(self, kind: str) -> DataFrame:
        frames = [self.spark.read.parquet(x[kind]) for x in self.levels]
        out = frames[0]
        for f in frames[1:]:
            out = out.union(f)
        return out

    def add(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add a batch rows(text); (texts, marks) after it.

        texts(t, u, copies, text) are the distinct texts of `short` bytes or more in the batch and those known before
        that it marks anew. marks(t, u, first, last) are ranges of window starts of them that repeat in `length` bytes
        anywhere in the family; a first of -1 says that a string of `short` bytes or more does. Of a text with copies
        above 1 no window need be named.
        """
        rows = rows.select(F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= self.short)
        texts = rows.groupBy(F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
        texts, path = self._written(texts, "texts")
        fresh = texts
        if self.levels:
            known = self._all("texts").select(*_KEYS)
            fresh, path = self._written(texts.join(known, _KEYS, "left_anti"), "texts")
        found, _ = self._written(self._regions(fresh), "regions")
        entries = found.groupBy("gram", "region").agg(F.count("*").alias("n"), F.min(F.struct("t", "u", "span")).alias("one"))
        entries = entries.select("gram", "region", "n", "one.t", "one.u", "one.span").sortWithinPartitions("gram", "region")
        entries, entries_path = self._written(entries, "entries")
        twice = entries.where("n > 1").select("gram", "region")
        pool, source = entries, texts
        if self.levels:
            # The merge scan: of the levels only entries of the batch's grams matter.
            old, _ = self._written(self._all("entries").join(entries.select("gram").distinct(), "gram", "left_semi"), "met")
            again = entries.select("gram", "region").join(old.select("gram", "region"), ["gram", "region"], "left_semi")
            twice = twice.union(again).distinct()
            pool = entries.union(old).groupBy("gram", "region").agg(F.min(F.struct("t", "u", "span")).alias("one")).select("gram", "region", "one.*")
        grams = pool.groupBy("gram").agg(F.count("*").alias("m"), F.max(F.col("span").bitwiseAND(F.lit(1))).alias("periodic")).where("m > 1 or periodic = 1")
        asked, _ = self._written(pool.join(grams, "gram").select("t", "u", "gram", "span", (F.col("m") > self.hot).alias("hot")), "asked")
        if self.levels:
            marked = self._all("texts").join(asked.union(old.select("t", "u", "gram", "span", F.lit(False))).select(*_KEYS).distinct(), _KEYS, "left_semi")
            copied = self._all("texts").join(texts.select(*_KEYS), _KEYS, "left_semi").withColumn("copies", F.lit(2).cast("long"))
            source = fresh.union(marked.join(copied.select(*_KEYS), _KEYS, "left_anti")).union(copied)
        whole = found.join(twice, ["gram", "region"]).select("t", "u", "span")
        if self.levels:
            whole = whole.union(old.join(again, ["gram", "region"], "left_semi").select("t", "u", "span"))
        first = F.shiftright("span", _FIRST)
        whole = whole.select("t", "u", first.alias("first"), (first + _width(F.col("span"))).alias("last"))
        marks, _ = self._written(self._searched(source, asked).union(whole), "marks")
        self._push(path, entries_path, entries.count())
        return source, marks

    def _push(self, texts: str, entries: str, size: int) -> None:
        """Make the batch a level, merge levels of equal size, and say so in family.json."""
        self.levels.append({"texts": texts, "entries": entries, "size": size})
        while len(self.levels) > 1 and self.levels[-2]["size"] < 2 * self.levels[-1]["size"]:
            two = [self.levels.pop() for _ in range(2)]
            a, b = [[self.spark.read.parquet(x[k]) for x in two] for k in ("texts", "entries")]
            _, texts = self._written(a[0].union(a[1]), "texts")
            both = b[0].union(b[1]).groupBy("gram", "region").agg(F.sum("n").alias("n"), F.min(F.struct("t", "u", "span")).alias("one"))
            merged, entries = self._written(both.select("gram", "region", "n", "one.t", "one.u", "one.span").sortWithinPartitions("gram", "region"), "entries")
            self.levels.append({"texts": texts, "entries": entries, "size": merged.count()})
        publish(f"{self.folder}/family.json", json.dumps({"parameters": [self.length, self.short, self.gram], "levels": self.levels}).encode())

    def _regions(self, texts: DataFrame) -> DataFrame:
        length, short, gram, part = self.length, self.short, self.gram, self.part

        def parts(data, offsets):
            """(first row, data, offsets, place in the text, own anchors) of runs of texts and of parts of long ones."""
            for a, b in slices(offsets, min(CHUNK_BYTES, 2 * part)):
                size = int(offsets[b] - offsets[a])
                if b > a + 1 or size <= 2 * part:
                    yield a, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], 0, None
                else:
                    # Parts are told apart by anchors, so that no region but a periodic one is cut.
                    for c in range(0, size, part):
                        start = max(0, c - short + gram)
                        some = data[offsets[a] + start : min(offsets[b], offsets[a] + c + part + length)]
                        yield a, some, np.array([0, len(some)]), start, (c - start, c - start + part)

        def find(batches):
            for batch in batches:
                t, u = batch.column("t").to_numpy(), batch.column("u").to_numpy()
                for a, data, offsets, place, own in parts(*byte_view(text_column(batch, "text"))):
                    text, first, last, anchor, periodic, g, r = regions(data, offsets, length, short, gram, own)
                    span = (first - offsets[text] + place) << _FIRST | (anchor - first) << _OFFSET | (last - first) << _WIDTH | periodic
                    yield pa.record_batch([pa.array(x) for x in (g.view(np.int64), r.view(np.int64), t[a + text], u[a + text], span)], ["gram", "region", "t", "u", "span"])

        return texts.select("t", "u", "text").mapInArrow(find, "gram long, region long, t long, u long, span long")

    def _searched(self, texts: DataFrame, asked: DataFrame) -> DataFrame:
        """marks(t, u, first, last) from the suffixes of the asked regions."""
        length, short, gram, limit = self.length, self.short, self.gram, self.batch
        windows = asked.agg(F.coalesce(F.sum(_width(F.col("span")) + 1), F.lit(0))).first()[0]
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), ceil(windows / TASK))
        lists = asked.groupBy(*_KEYS).agg(F.collect_list(F.struct("gram", "hot", "span")).alias("asked"))

        def cut(batches):
            for batch in batches:
                data, offsets = byte_view(text_column(batch, "text"))
                ts, us, lists = batch.column("t").to_pylist(), batch.column("u").to_pylist(), batch.column("asked")
                flat, bound = lists.flatten(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
                grams, spans = flat.field("gram"), flat.field("span")
                part = (grams.to_numpy() % parts).tolist()
                hot = flat.field("hot").to_numpy(zero_copy_only=False).tolist()
                first, _, width, _ = (x.tolist() for x in _unpack(spans.to_numpy()))
                grams, spans = grams.to_pylist(), spans.to_pylist()
                rows, held, dealt = [], 0, []
                for i, (t, u) in enumerate(zip(ts, us, strict=True)):
                    text = data[offsets[i] : offsets[i + 1]]
                    for q in range(bound[i], bound[i + 1]):
                        piece = text[first[q] : first[q] + width[q] + length]
                        if hot[q]:
                            dealt.append((t, u, first[q], width[q] + 1, piece))
                        else:
                            rows.append((0, part[q], grams[q], t, u, spans[q], piece.tobytes(), None))
                        held += len(piece) * (16 if hot[q] else 1)
                        if held > 16 << 20:
                            yield _batch([*rows, *prints(dealt)])
                            rows, held, dealt = [], 0, []
                if rows or dealt:
                    yield _batch([*rows, *prints(dealt)])

        def prints(dealt):
            """Rows of fingerprints in both lengths, dealt by the shorter; equal ones of these pieces are marked here and sent once."""
            if not dealt:
                return []
            owner, place, low, high = [], [], [], []
            for k, (_, _, first, width, piece) in enumerate(dealt):
                at = np.arange(width)
                roll = Rolling(piece)
                full = at + length <= len(piece)
                low.append(roll.ranges(at, at + short))
                high.append(np.where(full, roll.ranges(at, np.minimum(at + length, len(piece))), np.uint64(0)))
                owner.append(np.full(width, k))
                place.append(at + first)
            owner, place, low, high = map(np.concatenate, (owner, place, low, high))
            level = _twins(low, high)
            rows = _marks(dealt, owner, place, level, parts)
            _, one = np.unique(np.stack([low, high], 1), axis=0, return_index=True)
            to = (low[one] % np.uint64(parts)).astype(np.int64)
            by = np.lexsort((one, owner[one], to))
            one, to = one[by], to[by]
            cuts = np.flatnonzero(np.r_[True, (to[1:] != to[:-1]) | (owner[one[1:]] != owner[one[:-1]])])
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(one)], strict=True):
                t, u, *_ = dealt[owner[one[a]]]
                some = one[a:b]
                rows.append((1, int(to[a]), 0, t, u, len(some), low[some].tobytes() + high[some].tobytes(), place[some].astype(np.int32).tobytes()))
            return rows

        def search(batches):
            kept, keys = Regions(length, short, gram), []
            low, high, owner, place = [], [], [], []
            for batch in batches:
                kind, _, grams, t, u, span = (c.to_pylist() for c in batch.columns[:6])
                first, offset, width, periodic = (x.tolist() for x in _unpack(batch.column("span").to_numpy()))
                data, at = batch.column("data"), batch.column("at")
                for i in range(batch.num_rows):
                    if kind[i] == 0:
                        if kept.held > limit and grams[i] != kept.now:
                            kept.search()
                            yield from _results(kept.texts, kept.marks)
                            kept.texts, kept.marks = [], []
                        kept.add(grams[i], t[i], u[i], first[i], offset[i], width[i], periodic[i], data[i].as_py())
                    elif kind[i] == 1:
                        both = np.frombuffer(data[i].as_buffer(), np.uint64)
                        low.append(both[: span[i]])
                        high.append(both[span[i] :])
                        owner.append(np.full(span[i], len(keys)))
                        place.append(np.frombuffer(at[i].as_buffer(), np.int32).astype(np.int64))
                        keys.append((t[i], u[i]))
                    else:
                        yield from _results([(t[i], u[i])], [(0, *_range(span[i]))])
            kept.search()
            yield from _results(kept.texts, kept.marks)
            if low:
                low, high, owner, place = map(np.concatenate, (low, high, owner, place))
                yield from _results(keys, _runs(owner, place, _twins(low, high)))

        pieces = texts.join(lists, _KEYS).select("t", "u", "text", "asked").mapInArrow(cut, _PIECE)
        # Each part is one task, whatever the hash of its number.
        dealt = pieces.repartitionById(parts, "part").sortWithinPartitions("kind", "gram")
        return dealt.mapInArrow(search, "t long, u long, first long, last long")


def _width(span):
    return F.shiftright(span, _WIDTH).bitwiseAND(F.lit(_WIDTHS))


def _twins(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each suffix: not alone in its shorter, or longer (0: too short) fingerprint."""
    level = np.zeros(len(low), np.uint8)
    for prints, mark in ((low, 1), (high, 2)):
        _, which, n = np.unique(prints, return_inverse=True, return_counts=True)
        level[(n[which] > 1) & (prints != 0)] = mark
    return level


def _runs(owner: np.ndarray, place: np.ndarray, level: np.ndarray) -> list[tuple[int, int, int]]:
    """(owner, first, last) of consecutive places of level 2, and (owner, -1, -1) for owners of any level."""
    hit = np.flatnonzero(level == 2)
    hit = hit[np.lexsort((place[hit], owner[hit]))]
    o, p = owner[hit], place[hit]
    new = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)]) if len(hit) else hit
    end = np.r_[new[1:], len(hit)] - 1 if len(hit) else hit
    return [*zip(o[new].tolist(), p[new].tolist(), p[end].tolist(), strict=True), *((k, -1, -1) for k in np.unique(owner[level > 0]).tolist())]


def _range(x: int) -> tuple[int, int]:
    """A mark (first, last) handed on in one number; -1 for (-1, -1)."""
    return (x >> 32, x & (1 << 32) - 1) if x >= 0 else (-1, -1)


def _marks(dealt: list[tuple], owner, place, level, parts: int) -> list[tuple]:
    """Rows of kind 2, which the search hands on."""
    return [(2, k % parts, 0, *dealt[k][:2], -1 if a < 0 else a << 32 | b, None, None) for k, a, b in _runs(owner, place, level)]


def _results(keys: list[tuple], marks: list[tuple]):
    if marks:
        o, first, last = np.array(sorted(set(marks)), np.int64).T
        key = np.array(keys, np.int64)
        yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in (key[o, 0], key[o, 1], first, last)], ["t", "u", "first", "last"])


def removed(texts: DataFrame, marks: DataFrame, length: int = LENGTH, short: int = SHORT) -> DataFrame:
    """(t, u, n_bytes, n_removed, spans, repeats, kept) for each of texts, from the marks of IndexFamily.add."""

    def take(batches):
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            data, offsets = byte_view(text_column(batch, "text"))
            copies, lists = batch.column("copies").to_pylist(), batch.column("marks").to_pylist()
            out, gone, kept, repeats = [], [], [], []
            for i, found in enumerate(lists):
                text = data[offsets[i] : offsets[i + 1]]
                n = len(text)
                if copies[i] > 1:
                    found = [{"first": 0, "last": n}]
                merged: list[list[int]] = []
                for s, e in sorted((x["first"], min(x["last"], n - length) + length) for x in found or () if 0 <= x["first"] <= n - length):
                    if merged and s <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], e)
                    else:
                        merged.append([s, e])
                stay = np.ones(n, bool)
                for s, e in merged:
                    stay[s:e] = False
                out.append([{"start": s, "end": e} for s, e in merged])
                gone.append(sum(e - s for s, e in merged))
                kept.append(text[stay].tobytes())
                repeats.append(bool(found))
            yield pa.record_batch([batch.column("t"), batch.column("u"), pa.array(np.diff(offsets)), pa.array(gone, pa.int64()), pa.array(out, span), pa.array(repeats), pa.array(kept, pa.binary())], ["t", "u", "n_bytes", "n_removed", "spans", "repeats", "kept"])

    lists = marks.groupBy(*_KEYS).agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    return texts.join(lists, _KEYS, "left").select("t", "u", "copies", "text", "marks").mapInArrow(take, "t long, u long, n_bytes long, n_removed long, spans array<struct<start:int,end:int>>, repeats boolean, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, short: int = SHORT, gram: int = GRAM, **options) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, repeats, kept_sha256, kept) for each row of docs(doc_id, text).

    Removed is each byte of the UTF-8 text covered by a `length`-byte string that also starts anywhere else in the
    input, in the same text included. spans are the maximal removed byte ranges, kept the remaining bytes. repeats says
    that the text holds a string of `short` bytes or more that also starts anywhere else. A null or empty text has 0
    bytes and nothing kept. Repeated rows are different places, so long ones are removed whole; ids may be null or
    repeat. Other columns are ignored; an empty table gives no rows.
    """
    texts, marks = IndexFamily(docs.sparkSession, None, length, short, gram, **options).add(docs)
    done = removed(texts, marks, length, short).withColumn("kept_sha256", F.sha2("kept", 256))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(1), "text").alias("u"), F.octet_length("text").cast("long").alias("n"), F.when(F.octet_length("text") < short, F.col("text").cast("binary")).alias("brief"))
    both = rows.join(done, _KEYS, "left")
    small = F.col("brief").isNotNull()
    return both.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(small, F.lit(0)).otherwise(F.col("n_removed")).cast("long").alias("n_removed"),
        F.when(small, F.array().cast("array<struct<start:int,end:int>>")).otherwise(F.col("spans")).alias("spans"),
        F.when(small, F.lit(False)).otherwise(F.col("repeats")).alias("repeats"),
        F.when(small, F.sha2("brief", 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(small, F.col("brief")).otherwise(F.col("kept")).alias("kept"),
    )


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All of documents, strings of 400 bytes; repeats also names documents with repeated strings of 300 bytes."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", "repeats")
