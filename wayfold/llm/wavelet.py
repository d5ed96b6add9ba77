"""Operator 2: token-ID output as one wavelet matrix per shard.

A shard file holds the token ids of whole documents in document order. Plane k keeps bit (levels - 1 - k) of every id
after the stable partitions by the planes above it; each plane has a rank directory, and every section is compressed.
From the one file: access(i), rank(id, i), count(id, a, b), select(id, k), occurrences(id) and decode().
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, byte_view, new_folder, open_fs, publish, slices, written

MAGIC = b"WVMATRX1"
#: Ids of one shard; a document is never cut, so a longer one is a shard of its own.
SHARD_TOKENS = 1 << 20
#: Words whose ids a Python worker remembers, some 30 bytes each.
REMEMBERED = 600_000
END_ID = 1
_BLOCK = 64  # bytes of a plane per entry of its rank directory
#: Marks that can end a word; ASCII only.
_MARKS = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"
#: Letters whose form after NFC and lower-casing ends in a combining mark, which is one piece with marks that follow.
_UNSAFE = "[\u0130\u0958-\u095f\u09dc-\u09dd\u09df\u0a33\u0a36\u0a59-\u0a5b\u0a5e\u0b5c-\u0b5d\u0f43\u0f4d\u0f52\u0f57\u0f5c\u0f69\ufb1d\ufb1f\ufb2a-\ufb36\ufb38-\ufb3c\ufb3e\ufb40-\ufb41\ufb43-\ufb44\ufb46-\ufb4e]"
_ONES = np.array([bin(x).count("1") for x in range(256)], np.uint16)


def _pack(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x)


def _listed(x: pa.Array) -> list:
    """Values of an array without nulls; much faster than to_pylist."""
    return x.to_numpy(zero_copy_only=False).tolist()


def _unpack(x: bytes) -> bytes:
    import zstandard

    return zstandard.decompress(x)


def build(ids: np.ndarray, doc_ids: list, lengths: np.ndarray) -> bytes:
    """The file of a shard: token ids of documents `doc_ids` (None allowed) with `lengths` ids each."""
    levels = max(1, int(ids.max(initial=0)).bit_length())
    now = ids.astype(np.uint16 if levels <= 16 else np.uint32)
    zeros, planes = [], []
    for k in range(levels - 1, -1, -1):
        bit = (now & now.dtype.type(1 << k)) != 0
        planes.append(np.packbits(bit, bitorder="little"))
        # Taking by position is several times faster than by mask.
        now = np.concatenate([now.take(np.flatnonzero(~bit)), now.take(np.flatnonzero(bit))])
        zeros.append(len(bit) - int(np.count_nonzero(bit)))
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([d if d is not None else 0 for d in doc_ids], np.int64)
    sections = [known.tobytes(), names.tobytes(), lengths.astype(np.int64).tobytes(), np.array(zeros, np.int64).tobytes()]
    for p in planes:
        padded = np.zeros(-(-len(p) // _BLOCK) * _BLOCK, np.uint8)
        padded[: len(p)] = p
        ones = np.cumsum(_ONES[padded].reshape(-1, _BLOCK).sum(1), dtype=np.uint32)
        sections += [p.tobytes(), np.r_[np.uint32(0), ones].astype("<u4").tobytes()]
    sections = [_pack(s) for s in sections]
    head = MAGIC + struct.pack("<QQII", len(ids), len(doc_ids), levels, len(sections)) + struct.pack(f"<{len(sections)}Q", *map(len, sections))
    return head + b"".join(sections)


class WaveletMatrix:
    """Reads a shard file. A plane is unpacked when it is first used."""

    def __init__(self, file: bytes):
        if file[:8] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        self.n, self.documents, self.levels, k = struct.unpack_from("<QQII", file, 8)
        sizes = struct.unpack_from(f"<{k}Q", file, 32)
        at = np.r_[0, np.cumsum(sizes)] + 32 + 8 * k
        self._section = lambda i: _unpack(file[int(at[i]) : int(at[i + 1])])
        known, names = np.frombuffer(self._section(0), np.uint8), np.frombuffer(self._section(1), np.int64)
        self.doc_ids = [int(d) if ok else None for d, ok in zip(names, known, strict=True)]
        self.lengths = np.frombuffer(self._section(2), np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.zeros = np.frombuffer(self._section(3), np.int64)
        self._planes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _plane(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._planes:
            self._planes[k] = np.frombuffer(self._section(4 + 2 * k), np.uint8), np.frombuffer(self._section(5 + 2 * k), "<u4")
        return self._planes[k]

    def _rank1(self, k: int, i: int) -> int:
        """Ones in the first i bits of plane k."""
        bits, ones = self._plane(k)
        block = i // (8 * _BLOCK)
        total = int(ones[block])
        rest = bits[block * _BLOCK : i // 8]
        total += int(_ONES[rest].sum())
        return total + (bin(int(bits[i // 8]) & ((1 << (i % 8)) - 1)).count("1") if i % 8 else 0)

    def _select(self, k: int, bit: int, js: np.ndarray) -> np.ndarray:
        """Positions of the j-th (from 0) bits of the kind in plane k: the directory finds the block, its bits the place."""
        bits, ones = self._plane(k)
        before = ones.astype(np.int64) if bit else 8 * _BLOCK * np.arange(len(ones), dtype=np.int64) - ones
        out = np.empty(len(js), np.int64)
        for a in range(0, len(js), 4096):
            some = js[a : a + 4096]
            block = np.searchsorted(before, some, "right") - 1
            at = block[:, None] * _BLOCK + np.arange(_BLOCK)
            inside = np.unpackbits(np.where(at < len(bits), bits[np.minimum(at, len(bits) - 1)], 0).astype(np.uint8), axis=1, bitorder="little") == bit
            out[a : a + len(some)] = block * (8 * _BLOCK) + (np.cumsum(inside, 1, dtype=np.int32) > (some - before[block])[:, None]).argmax(1)
        return out

    def _bit(self, token: int, k: int) -> int:
        return token >> (self.levels - 1 - k) & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for k in range(self.levels):
            bit = int(self._plane(k)[0][i // 8]) >> (i % 8) & 1
            ones = self._rank1(k, i)
            i = int(self.zeros[k]) + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _descend(self, token: int, a: int, b: int) -> tuple[int, int]:
        for k in range(self.levels):
            x, y = self._rank1(k, a), self._rank1(k, b)
            a, b = (int(self.zeros[k]) + x, int(self.zeros[k]) + y) if self._bit(token, k) else (a - x, b - y)
        return a, b

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        """How often the id occurs in positions a to b."""
        if token < 0 or token >> self.levels:
            return 0
        low, high = self._descend(token, a, self.n if b is None else b)
        return high - low

    def rank(self, token: int, i: int) -> int:
        return self.count(token, 0, i)

    def _positions(self, token: int, js: np.ndarray) -> np.ndarray:
        at = self._descend(token, 0, 0)[0] + js
        for k in range(self.levels - 1, -1, -1):
            bit = self._bit(token, k)
            at = self._select(k, bit, at - int(self.zeros[k]) if bit else at)
        return at

    def select(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of the id."""
        if not 0 <= j < self.count(token):
            raise IndexError(j)
        return int(self._positions(token, np.array([j]))[0])

    def occurrences(self, token: int) -> list[int]:
        """Positions of all occurrences of the id, in order."""
        n = self.count(token)
        return self._positions(token, np.arange(n)).tolist() if n else []

    def decode(self) -> np.ndarray:
        """All ids, by undoing the partitions from the last plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for k in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self._plane(k)[0], count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            zeros = int(self.zeros[k])
            above[np.flatnonzero(~bit)] = now[:zeros]
            above[np.flatnonzero(bit)] = now[zeros:] | kind(1 << (self.levels - 1 - k))
            now = above
        return now


def _gather(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[first[k]:first[k] + size[k]] for all k, one after another."""
    end = np.cumsum(size)
    return values[np.repeat(first - end + size, size) + np.arange(int(size.sum()))]


class WordEncoder:
    """Encodes whole texts with a tokenizers file whose pre-tokenizer never joins text across white space.

    The ids of a text are then those of its white-space separated words in order, so each word is encoded once and
    remembered: an Arrow array of words beside flat arrays of their ids. Texts with the separators U+001C to U+001F, on
    which Arrow and the tokenizer disagree, or with an added token in any case, which is found before lower-casing, are
    encoded as they are. `local=False` encodes every text whole.
    """

    def __init__(self, path: str, local: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.local = Tokenizer.from_file(path), local
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        model = json.loads(self.tokenizer.to_str())
        added = "|".join(re.escape(t["content"]) for t in model["added_tokens"])
        self.apart = "[\x1c-\x1f]" + (f"|(?i:{added})" if added else "")
        self.lowers = "Lowercase" in json.dumps(model["normalizer"])
        suffix = model["model"].get("end_of_word_suffix")
        self.ends = None
        if suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.known = _Known(self.kind)
        self.marks = _Known(self.kind)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array; null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not self.local:
            return [np.array(x, self.kind) for x in self._encode(_listed(texts))]
        whole = pc.match_substring_regex(texts, self.apart)
        apart = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        lists = pc.utf8_split_whitespace(self._lowered(pc.if_else(whole, "", texts)))
        # A text of blanks only, or none, splits into empty strings, which have no ids.
        coded = lists.flatten().dictionary_encode()
        ids, first, size = self._words(coded.dictionary)
        code = coded.indices.to_numpy()
        sizes = size[code]
        ids = _gather(ids, first[code], sizes)
        at = np.r_[0, np.cumsum(sizes)][np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]]
        out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for k, x in zip(apart.tolist(), self._encode(_listed(texts.take(pa.array(apart)))), strict=True):
            out[k] = np.array(x, self.kind)
        return out

    def _lowered(self, texts: pa.Array) -> pa.Array:
        """A-Z lowered in texts within U+0000 to U+00FF, where no mark composes with a letter; others as they are."""
        if not self.lowers:
            return texts
        return pc.if_else(pc.match_substring_regex(texts, "[^\x00-\u00ff]"), texts, pc.ascii_lower(texts))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, size) of distinct words. ASCII marks after letters are a piece of their own, save after _UNSAFE ones."""
        core = pc.ascii_rtrim(words, characters=_MARKS)
        letters = pc.and_not(pc.utf8_is_alpha(core), pc.match_substring_regex(core, _UNSAFE))
        cut = pc.and_(letters, pc.not_equal(pc.binary_length(core), pc.binary_length(words)))
        coded = pc.if_else(letters, core, words).dictionary_encode()
        first, size = self.known(coded.dictionary, self._learn)
        code = coded.indices.to_numpy()
        at = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        ends = words.take(pa.array(at))
        # The tail of a word is what follows its core, byte for byte.
        data, offsets = byte_view(ends.cast(pa.large_string()).cast(pa.large_binary()))
        size_of = pc.binary_length(core.take(pa.array(at))).to_numpy()
        length = np.diff(offsets) - size_of
        body = _gather(data, offsets[:-1] + size_of, length)
        tails = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.r_[0, np.cumsum(length)].astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))])
        coded = tails.dictionary_encode()
        tail_first, tail_size = self.marks(coded.dictionary, lambda new: self._encode(_listed(new)))
        tail = coded.indices.to_numpy()
        # Two segments a word, the core in the one pool and the tail in the other behind it.
        pool = np.concatenate([self.known.ids, self.marks.ids])
        firsts, sizes = np.zeros((len(words), 2), np.int64), np.zeros((len(words), 2), np.int64)
        firsts[:, 0], sizes[:, 0] = first[code], size[code]
        firsts[at, 1], sizes[at, 1] = tail_first[tail] + len(self.known.ids), tail_size[tail]
        ids = _gather(pool, firsts.ravel(), sizes.ravel())
        size = sizes.sum(1)
        return ids, np.cumsum(size) - size, size

    def _learn(self, words: pa.Array) -> list:
        """The ids of new words. Words of letters only are one piece each: many are encoded as one text and cut at the ids that end a word."""
        words = _listed(words)
        out: list = [None] * len(words)
        plain = [k for k, w in enumerate(words) if w.isalpha()] if self.ends is not None else []
        for a in range(0, len(plain), 20_000):
            some = plain[a : a + 20_000]
            ids = np.array(self._encode([" ".join([words[k] for k in some])])[0], self.kind)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                for k, x, y in zip(some, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                    out[k] = ids[x:y]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self._encode([words[k] for k in rest]), strict=True):
            out[k] = x
        return out


class _Known:
    """Remembered strings and their ids. Beyond REMEMBERED strings only those of the last call stay."""

    def __init__(self, kind):
        self.kind = kind
        self.forget()

    def forget(self) -> None:
        self.strings = pa.array([], pa.large_string())
        self.ids, self.first, self.size = np.zeros(0, self.kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, strings: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """(first, size) in self.ids of distinct strings; learn(new strings) gives their lists of ids."""
        if len(self.strings) > REMEMBERED:
            at = pc.index_in(strings, value_set=self.strings).drop_null()
            kept = self.strings.take(at)
            at = at.to_numpy()
            ids, size = _gather(self.ids, self.first[at], self.size[at]), self.size[at]
            self.strings, self.ids, self.first, self.size = kept, ids, np.cumsum(size) - size, size
        at = pc.index_in(strings, value_set=self.strings)
        new = strings.filter(pc.is_null(at))
        if len(new):
            lists = learn(new)
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            ids = np.concatenate([np.asarray(x, self.kind) for x in lists])
            first = np.cumsum(size) - size + len(self.ids)
            fresh = np.flatnonzero(pc.is_null(at).to_numpy(zero_copy_only=False))
            place = pc.fill_null(at, 0).to_numpy().astype(np.int64)
            place[fresh] = len(self.strings) + np.arange(len(new))
            self.strings = pa.concat_arrays([self.strings, new.cast(pa.large_string())])
            self.ids, self.first, self.size = np.concatenate([self.ids, ids]), np.r_[self.first, first], np.r_[self.size, size]
        else:
            place = at.to_numpy().astype(np.int64)
        return self.first[place], self.size[place]


_ENCODERS: dict[tuple, WordEncoder] = {}


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, local: bool = True) -> tuple[DataFrame, str]:
    """Encode docs(doc_id, text), write shard files in ascending doc_id order; (table of files, folder).

    Null texts count as empty; null ids come first; rows of one id are ordered by a hash of the text, then the text, so
    that many of them are dealt out as well. Every document ends with end_id. A task that runs again writes the same files.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = new_folder(spark, "tokens")
    n = max(docs.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches):
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        encoder = _ENCODERS.setdefault((tokenizer, local), None) or WordEncoder(tokenizer, local)
        _ENCODERS[tokenizer, local] = encoder
        ids, lengths, held, total = [], [], [], 0
        end = np.array([end_id], encoder.kind)

        def flush():
            path = f"{folder}/part-{part:06d}-{shard:06d}.wvm"
            publish(path, build(np.concatenate(held), ids, np.array(lengths)))
            return pa.record_batch([[part], [shard], [path], [len(ids)], [total]], names=["part", "shard", "path", "documents", "tokens"])

        for batch in batches:
            names, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            ends = np.r_[0, np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)]
            for at, stop in slices(ends, 4 << 20):
                for d, x in zip(names[at:stop], encoder(texts.slice(at, stop - at)), strict=True):
                    k = len(x) + 1
                    if total and total + k > shard_tokens:
                        yield flush()
                        ids, lengths, held, total, shard = [], [], [], 0, shard + 1
                    ids.append(d)
                    lengths.append(k)
                    held += [x, end]
                    total += k
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    files = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").mapInArrow(run, "part long, shard long, path string, documents long, tokens long")
    return written(files, "token-files"), folder


def _bases(files: DataFrame) -> DataFrame:
    """files with `base`, the ids of all files before, as sums over the files of a part, the parts of a block and the blocks."""
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n")).withColumn("block", F.expr("part div 1000"))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n")).select("block", before(Window.orderBy("block")).alias("block_base"))
    parts = parts.select("part", "block", before(Window.partitionBy("block").orderBy("part")).alias("part_base")).join(blocks, "block")
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.select("part", "path", inside.alias("inside")).join(parts, "part").select("path", (F.col("inside") + F.col("part_base") + F.col("block_base")).alias("base"))


def read_shards(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, path) of every document, decoded from the shard files."""

    def run(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, p = open_fs(path)
                with fs.open_input_file(p) as f:
                    shard = WaveletMatrix(f.read())
                ids = shard.decode().astype("<u4")
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(shard.starts[:-1], shard.starts[1:], strict=True)]
                yield pa.record_batch([pa.array(shard.doc_ids, pa.int64()), pa.array(shard.starts[:-1] + base, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(crc, pa.int64()), pa.array([path] * len(crc), pa.string())], ["doc_id", "start", "n_tokens", "ids_crc32", "path"])

    # A row stands for a file of some megabytes, so rows are dealt one by one; adaptive execution would join them by their own bytes.
    n = max(4 * files.sparkSession.sparkContext.defaultParallelism, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return _bases(files).repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, path string")


def token_output(docs: DataFrame, tokenizer: str | None = None, **options) -> DataFrame:
    """Write docs as wavelet-matrix shards and return what the files hold per document (see read_shards).

    An empty table gives no file and no row; other columns are ignored.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    files, _ = write_shards(docs, tokenizer, **options)
    return read_shards(files).drop("path")


def op2_token_wavelet(spark, sf_dir: str) -> DataFrame:
    """All of documents, word_bpe_49k, end id 1."""
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
