"""Small tests of the training-data operators: edge cases, brute force, round trips, held-out accuracy."""

import datetime
import hashlib
import itertools
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import SMALL, rows_of
from pyspark.sql import functions as F

from wayfold.llm import decontaminate, hamming, language, line_runs, mixing, ngram_join, pseudonyms, suffix_dedup, warc, wavelet
from wayfold.llm.components import components
from wayfold.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n, rng):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def edge_docs(spark):
    """Null ids, texts, labels; empty, blank, short and long texts; repeated rows; columns that clash with results."""
    rng = random.Random(9)
    long = prose(4000, rng)
    base = prose(60, rng)
    near = base.split()
    near[30] = "changed"
    texts = [(1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n"), (7, "one two"), (8, "ONE two"), (None, base), (None, None), (9, long), (10, long), (11, "12 !! 34"), (3, " ".join(near)), (12, "é́ \x1c ß 漢字 \U0001f600")]
    rows = [(d, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "x", "y", 1.0, 7) for i, (d, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", score string, lang_pred string, size double, k int")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


# 1


def test_language_is_right_on_held_out_rows(spark):
    d = language.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    r = d.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    assert r.n > 250 and r.a > 0.98 and 0 <= r.low <= r.high <= 1
    held = {r.doc_id: r.held_out for r in d.collect()}
    assert all(h == (zlib.crc32(str(k).encode()) % 3 == 1) for k, h in held.items())


def test_language_edges(spark):
    got = language.predict(edge_docs(spark)).collect()
    assert len(got) == 15
    assert sorted(r.doc_id or 0 for r in got if r.lang_pred == "und") == [0, 4, 5, 6, 11]
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    empty = edge_docs(spark).limit(0)
    assert language.predict(empty).count() == 0
    unlabelled = edge_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.predict(unlabelled).collect()} == {"und"}


@pytest.mark.parametrize("n", [1, 2, 4, 6, 7, 40])
def test_codewords_are_far_apart(n):
    code = language.codewords(n)
    gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert not gaps or min(gaps) >= (1 if n == 2 else 2)
    assert n == 1 or all(abs(c.sum()) < n for c in code.T)


def test_decoding_corrects_a_wrong_bit():
    m = language.Model(["a", "b", "c", "d"], np.ones((4, 8), np.int64))
    margins = (m.code * 4).astype(np.float32)
    margins[:, 2] *= -1
    best, score, ambiguous = m.decode(margins)
    assert best.tolist() == [0, 1, 2, 3] and (score < 1).all() and not ambiguous.any()
    assert m.decode(np.zeros((1, m.code.shape[1]), np.float32))[2].all()


# 2


@pytest.mark.parametrize("top", [2, 300, 70_000])
def test_wavelet_matrix_against_plain_arrays(top):
    ids = np.random.default_rng(top).integers(0, top, 3000).astype(np.uint32)
    w = wavelet.WaveletMatrix(wavelet.build(ids, [7, None], np.array([1000, 2000])))
    assert (w.decode() == ids).all() and w.doc_ids == [7, None]
    for i in (0, 511, 512, 2999):
        assert w.access(i) == ids[i]
    t = int(ids[17])
    places = np.flatnonzero(ids == t)
    assert w.occurrences(t) == places.tolist()
    assert w.count(t, 100, 2000) == ((places >= 100) & (places < 2000)).sum() and w.rank(t, 50) == (places < 50).sum()
    assert w.count(top * 8) == 0
    with pytest.raises(IndexError):
        w.select(t, len(places))
    empty = wavelet.WaveletMatrix(wavelet.build(ids[:0], [], np.zeros(0)))
    assert len(empty.decode()) == 0


def test_tokens_equal_whole_text_encoding(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for docs in (edge_docs(spark), spark.read.parquet(f"{SMALL}/documents.parquet")):
        # Ids ascend, null first; rows of one id are in the order of Spark's xxhash64 of the text (its seed for null).
        hashed = lambda x: 42 if x is None else int(np.uint64(xxhash.xxh64(x.encode(), seed=42).intdigest()).view(np.int64))
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, hashed(r.text), r.text or "") for r in docs.collect()))
        want, start = [], 0
        for known, d, _, x in rows:
            ids = np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4")
            want.append((d if known else None, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = wavelet.token_output(docs, shard_tokens=5000).collect()
        assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert wavelet.token_output(edge_docs(spark).limit(0)).count() == 0


def test_marks_after_letters_and_added_tokens_equal_whole_text_encoding():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    unsafe = [c for c in map(chr, range(0xD800)) if c.isalpha() and not unicodedata.normalize("NFC", c).lower().isalpha()]
    texts = ["CUMHURİYETİ.", "A <|ENDOFTEXT|> B.", "x<|StartOfText|>.", "y<|endoftext|>", "<| A. |>", None, *[f"x{c}. {c}A, y{c}!" for c in [*unsafe, *"áÅßŉǰΐẞ漢ﬁ\ufb1d\ufb1f\ufb4e"]]]
    got, want = [[x.tolist() for x in wavelet.WordEncoder(path, local)(pa.array(texts))] for local in (True, False)]
    assert got == want


def test_random_unicode_equals_whole_text_encoding(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(wavelet, "REMEMBERED", 50)
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(21)
    blanks = [c for c in map(chr, range(0x10000)) if c.isspace() or unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc", "Cf")]
    marks = "!\"#$%&()*+,-./:;=?@[\\]^_`{|}~'0123456789\u0301\u0307\u0130\u0131\u00df\u02b0"
    pools = ["abcXYZ", marks, blanks, [chr(c) for c in range(0xA0, 0x250)], [chr(c) for c in range(0x300, 0x1200)], [chr(c) for c in range(0x1E00, 0x2100)], [chr(c) for c in range(0xFB00, 0xFF60)], [chr(c) for c in range(0x10300, 0x10450)]]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    encoder, whole = wavelet.WordEncoder(path), wavelet.WordEncoder(path, False)
    for a in range(0, len(texts), 500):
        some = pa.array(texts[a : a + 500])
        assert [x.tolist() for x in encoder(some)] == [x.tolist() for x in whole(some)]


def test_file_starts_are_sums_over_parts_and_blocks(spark):
    rows = [(p, s, f"{p}-{s}", 1, 10 * p + s + 1) for p in (0, 1, 999, 1000, 1001, 2500) for s in range(3)]
    got = {r.path: r.base for r in wavelet._bases(spark.createDataFrame(rows, "part long, shard long, path string, documents long, tokens long")).collect()}
    base = 0
    for _, _, path, _, n in rows:
        assert got[path] == base
        base += n
    assert len(got) == len(rows)


# 3


def brute_components(rows, percent=75):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {d: d for d, _ in rows if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j in range(i):
            b, both = rows[j][0], len(sets[i] & sets[j])
            if a is not None and b is not None and both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(((d, len(s), find(d) if d is not None else None) for (d, _), s in zip(rows, sets, strict=True)), key=str)


@pytest.mark.parametrize("block", [1_000_000, 300])
def test_join_against_all_pairs(spark, block):
    rng, rows = random.Random(3), []
    shared = prose(40, rng)
    for c in range(12):
        words = (prose(rng.randint(3, 120), rng) + (" " + shared if c % 3 == 0 else "")).split()
        for _ in range(rng.randint(1, 9)):
            w = list(words)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((len(rows), " ".join(w)))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in ngram_join.link_components(d, block=block).collect()]
    assert sorted(got, key=str) == brute_components(rows)


def test_join_edges(spark):
    d = edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert sorted((tuple(r) for r in ngram_join.link_components(d).collect()), key=str) == brute_components(rows)
    assert ngram_join.link_components(d.limit(0)).count() == 0


def test_t_occurrence_with_and_without_long_lists():
    rng = np.random.default_rng(1)
    hot = np.arange(40, dtype=np.uint64)
    sets = sorted((np.unique(np.r_[hot, rng.integers(100, 160, n).astype(np.uint64)]) for n in rng.integers(1, 60, 60)), key=len)
    forest = ngram_join.Forest(len(sets))
    ngram_join.t_occurrence(sets, range(len(sets)), 75, forest, range(len(sets)))
    want = ngram_join.Forest(len(sets))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                want.join(i, j)
    assert [forest.find(k) for k in range(len(sets))] == [want.find(k) for k in range(len(sets))]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(5, 5), (None, 3), (119, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and all(got[i] == 100 for i in [*range(100, 120), 200]) and len(got) == 52


# 4


def test_warc_round_trip_and_edges(spark):
    big = "<p>" + "ü" * 200 + "</p>\r\n\r\nWARC/1.1\r\n"
    rows = [(3, "http://a/ b\r\nX: y", big, 1), (1, None, big, 1), (2, "u", big, 1), (4, "u", "short", 1), (5, "u", "short", 1), (6, "u", None, 1), (None, "u", big, 1), (1, None, big, 1), (7, "u", "x" * 100, 1), (8, "u", "x" * 100, 1)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    index = warc.write_warc(d)
    got = sorted(map(tuple, warc.page_digests(index).collect()), key=str)
    want = []
    for p, _, h, _ in rows:
        b = (h or "").encode()
        least = min((q for q, _, g, _ in rows if g == h and q is not None), default=None)
        again = len(b) >= 100 and p is not None and p > least
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", least if again else None))
    assert got == sorted(want, key=str)
    chosen = warc.read_warc(index.where("page_id in (4, 7)")).collect()
    assert sorted((r.page_id, bytes(r.payload)) for r in chosen) == [(4, b"short"), (7, b"x" * 100)]
    assert warc.page_digests(warc.write_warc(d.limit(0))).count() == 0
    alone = warc.page_digests(index.where("page_id = 8")).collect()
    assert [tuple(r) for r in alone] == [(8, None, hashlib.sha256(b"x" * 100).hexdigest(), "revisit", 7)]
    h, payload = warc.parse_record(b"WARC/1.0\r\nWARC-Type: resource\r\ncontent-length:4\r\nContent-Type: text/plain\r\n\r\nbody\r\n\r\n")
    assert h["warc-type"] == "resource" and payload == b"body"


def test_near_ranges_are_read_as_one():
    assert warc.coalesce([(0, 10), (10, 5), (20, 5), (100, 5)], gap=5, most=1000) == [(0, 25, 0, 3), (100, 105, 3, 4)]
    assert warc.coalesce([(0, 10), (10, 10), (20, 10)], gap=5, most=20) == [(0, 20, 0, 2), (20, 30, 2, 3)]
    assert warc.coalesce([]) == []


# 5


def test_hamming_search_against_all_distances(spark):
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**64, 5, dtype=np.uint64)
    codes = [int((centres[k % 5] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 6).astype(np.uint64))).view(np.int64)) for k in range(300)]
    rows = [(k, c) for k, c in enumerate(codes)] + [(0, codes[0]), (7, codes[9])]
    d = spark.createDataFrame(rows, "id long, code long")
    got = {}
    for r in hamming.top_k(d, d.where("id % 50 = 0"), 10, shard_rows=20, block_rows=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.neighbor_id))
    first = {}
    for k, c in rows:
        first[k] = min(first.get(k, c), c)
    for q in range(0, 300, 50):
        far = sorted(((bin((first[q] ^ c) & (2**64 - 1)).count("1"), k) for k, c in set(rows) if k != q))[:10]
        assert sorted(got[q]) == [(i + 1, f, k) for i, (f, k) in enumerate(far)]


def test_hamming_edges(spark):
    v = spark.createDataFrame([(1, [0.5] * 64), (2, None), (None, [1.0] * 64), (50, [-1.0] * 64), (100, [])], "vec_id long, embedding array<float>")
    c = hamming.sign_codes(v)
    assert {r.id: r.code for r in c.collect()} == {1: -1, 50: 0, 100: 0}
    assert sorted((r.query_id, r.neighbor_id, r.distance) for r in hamming.top_k(c, c.where("id % 50 = 0"), 5).collect()) == [(50, 1, 64), (50, 100, 0), (100, 1, 64), (100, 50, 0)]
    assert hamming.top_k(c.limit(0), c.limit(0), 5).count() == 0


# 6


def test_flow_prefers_unrepeated_tokens_of_overlapping_sources():
    flow = mixing.min_cost_flow([100, 100, 50], [[0], [1], [0, 1]], [150, 100], 3)
    assert flow == {(0, 0): 100, (1, 1): 100, (2, 0): 50}
    assert sum(mixing.min_cost_flow([10], [[0]], [100], 3).values()) == 30
    assert mixing.min_cost_flow([], [], [], 3) == {}


def test_targets_stop_and_are_shared_again():
    assert mixing.targets([100, 100], [1, 3]) == [50.0, 150.0]
    assert mixing.targets([10, 1000], [9, 1]) == [30.0, 980.0]
    assert mixing.targets([0, 10], [1, 1]) == [0.0, 10.0] and mixing.targets([], []) == []


def test_mix_edges_and_overlap(spark):
    d = edge_docs(spark)
    got = mixing.mix(d).collect()
    assert len(got) == 15 and all(r.taken in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in got)
    assert mixing.mix(d.limit(0)).count() == 0
    rng = random.Random(2)
    rows = [(k, prose(20, rng), rng.choice([["a"], ["b"], ["a", "b"], None, []])) for k in range(600)]
    over = spark.createDataFrame(rows, "doc_id long, text string, source array<string>")
    a, b = (mixing.mix(over).orderBy("doc_id").collect() for _ in range(2))
    assert a == b
    taken = sum(r.taken for r in a)
    want = sum(mixing.targets([sum(r["size"] for r in a if x in r.pattern) for x in ("a", "b", None)], [1, 2, 3]))
    assert abs(taken - min(want, 3 * 600 * 20)) < 60


def test_tied_ranks_are_split_and_null_ids_reach_the_target(spark):
    rows = [(None, prose(2, random.Random(k)), "a" if k % 2 else "b") for k in range(100)] + [(7, "one two", "a")] * 50 + [(7, "one two", "b")] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    whole = mixing.mix(d).collect()
    assert len(whole) == 200 and sum(r.n for r in got) == 200
    for x, weight in (("a", 1), ("b", 2)):
        taken = sum(r.taken for r in whole if r.pattern == [x])
        assert abs(taken - 400 * weight / 3) <= 2
    assert sorted(map(str, whole)) == sorted(map(str, mixing.mix(d.repartition(7)).collect()))


# 7


KEY = "secret"


def permuted(values, sizes, kind, key=KEY, back=False):
    v, half = list(values), len(values) // 2
    for r in range(pseudonyms.ROUNDS)[:: -1 if back else 1]:
        left = r % 2 == 0
        other = v[half:] if left else v[:half]
        h = "".join(hashlib.sha256("|".join([key, kind, str(r), str(b), ",".join(map(str, other))]).encode()).hexdigest()[:60] for b in range(len(v) // 12 + 1))
        for i in range(len(v)):
            if (i < half) == left:
                add = int(h[i * 5 : i * 5 + 5], 16)
                v[i] = (v[i] + (-add if back else add)) % sizes[i]
    return v


def brute_luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10


def test_pseudonyms_against_plain_python(spark):
    text = "card 4111 1111 1111 1111, not 4111111111111112; ip 10.0.255.1; on 2024-02-29 not 2024-02-30; +1 (743) 555-3824; a.B9@x.org; 123-45-6789 000-12-3456"
    got = pseudonyms.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), KEY).first()
    card = permuted([4, *[1] * 14], [10] * 15, "number")
    card.append((10 - brute_luhn([*card, 0])) % 10)
    s = "".join(map(str, card))
    assert f"card {s[:4]} {s[4:8]} {s[8:12]} {s[12:]}, not 4111111111111112" in got.text and brute_luhn(card) == 0
    assert "ip " + ".".join(map(str, permuted([10, 0, 255, 1], [256] * 4, "ip"))) in got.text
    day = (datetime.date(2024, 2, 29) - datetime.date(1900, 1, 1)).days
    while True:
        a, b = permuted(divmod(day, 270), (271, 270), "date")
        if (day := a * 270 + b) < pseudonyms.DAYS:
            break
    assert f"on {datetime.date(1900, 1, 1) + datetime.timedelta(day)} not 2024-02-30" in got.text
    phone = permuted([5, 4, 3, 3, 5, 5, 3, 8, 2, 4], [8, 10, 10, 8, 10, 10, 10, 10, 10, 10], "phone")
    phone[0] += 2
    phone[3] += 2
    p = "".join(map(str, phone))
    assert f"+1 ({p[:3]}) {p[3:6]}-{p[6:]}" in got.text
    e = permuted([0, 0, 1, 9], [26, 1, 26, 10], "email")
    assert f"{chr(97 + e[0])}.{chr(65 + e[2])}{e[3]}@x.org" in got.text
    n = permuted([122, 44, 6788], [898, 99, 9999], "ssn")
    assert f"{n[0] + 1 + (n[0] + 1 >= 666):03d}-{n[1] + 1:02d}-{n[2] + 1:04d} 000-12-3456" in got.text
    assert (got.n_card, got.n_ip, got.n_date, got.n_phone, got.n_email, got.n_ssn, got.n_replaced) == (1, 1, 1, 1, 1, 1, 6)


def test_pseudonyms_link_and_can_be_undone(spark):
    values = [(k, f"call 743-555-{k:04d} now") for k in range(500)]
    d = spark.createDataFrame(values + values, "doc_id long, text string")
    found = {}
    for r in pseudonyms.pseudonymize(d, KEY).collect():
        found.setdefault(r.doc_id, set()).add(r.text)
    assert all(len(x) == 1 for x in found.values()) and len(set.union(*found.values())) == 500
    sizes = [10] * 15
    assert permuted(permuted(list(range(9)) + [1] * 6, sizes, "number"), sizes, "number", back=True) == list(range(9)) + [1] * 6


def test_pseudonym_edges(spark):
    d = edge_docs(spark).withColumn("n_card", F.lit("clash"))
    got = pseudonyms.pseudonymize(d, KEY)
    assert [r.text for r in got.collect()] == [r.text for r in d.collect()]
    assert got.agg(F.sum("n_replaced")).first()[0] == 0 and got.columns.count("n_card") == 1
    assert pseudonyms.pseudonymize(d.limit(0), KEY).count() == 0


def test_pseudonyms_over_a_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    after = {r.doc_id: r for r in pseudonyms.op7_pseudonyms(spark, SMALL).collect()}
    assert before.keys() == after.keys()
    shape = lambda t: re.sub(r"[0-9]+", "0", re.sub(r"[A-Za-z0-9]+(?=[A-Za-z0-9._+-]*@)", lambda m: "x" * len(m[0]), t or ""))
    linked, changed = {}, 0
    for k, r in after.items():
        assert shape(r.text) == shape(before[k]) and (r.n_replaced > 0 or r.text == before[k])
        changed += r.n_replaced > 0
        for a, b in zip(re.findall(pseudonyms.EMAIL, before[k] or ""), re.findall(pseudonyms.EMAIL, r.text or ""), strict=True):
            assert linked.setdefault(a, b) == b
    assert changed > 5 and len(set(linked.values())) == len(linked) > 0
    long = "a" * 40 + "1" * 20
    got = pseudonyms.pseudonymize(spark.createDataFrame([(1, f"{long}@x.org")], "doc_id long, text string"), KEY).first().text
    assert got == "".join(chr(97 + v) for v in permuted([0] * 40 + [1] * 20, [26] * 40 + [10] * 20, "email")[:40]) + "".join(map(str, permuted([0] * 40 + [1] * 20, [26] * 40 + [10] * 20, "email")[40:])) + "@x.org"
    with pytest.raises(ValueError):
        pseudonyms.pseudonymize(docs, "")


# 8


def test_decontamination_tolerates_substitutions(spark):
    rng = random.Random(8)
    item = prose(30, rng).split()
    swapped = list(item)
    for k in (3, 9, 16, 23):
        swapped[k] = "other"
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (None, prose(20, rng)), (4, ""), (6, " ".join(f"brief{k}" for k in range(9)))], "item_id long, text string")
    rows = [(1, prose(50, rng) + " " + " ".join(swapped).upper() + ", " + prose(50, rng)), (2, prose(300, rng)), (3, " ".join(item[:14])), (4, None), (5, ""), (None, " ".join(item)), (3, " ".join(item[:14])), (6, " ".join(item[:9])), (8, "so " + " ".join(f"brief{k}" for k in range(9))), (9, " ".join(f"brief{k}" for k in range(8))), (1, "a clean text of the same id")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(d, bench).collect()) == [(1, 1), (3, 1), (8, 6)]
    kept = decontaminate.decontaminate(d, bench)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "6", "9", "None"] and kept.columns == d.columns
    assert decontaminate.decontaminate(d.limit(0), bench).count() == 0 and decontaminate.decontaminate(d, bench.limit(0)).count() == 11


def test_seeds_hit_every_placement_of_differing_words():
    n, k = decontaminate.WINDOW, decontaminate.WINDOW - decontaminate.MATCHES
    picks = [[o + j for j, c in enumerate(m) if c == "1"] for m in decontaminate.SEEDS for o in range(n - len(m) + 1)]
    assert all(any(not set(p) & set(gone) for p in picks) for gone in itertools.combinations(range(n), k))


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_against_all_diagonals(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    rng = random.Random(88)
    items = [prose(rng.choice([13, 14, 15, 20, 31]), rng).split() for _ in range(40)]
    docs = []
    for k in range(400):
        v = items[k % 40]
        a = rng.randint(0, len(v) - 10) if k % 3 else 0
        part = [f"other{i}" if rng.random() < 0.2 else w for i, w in enumerate(v[a:])]
        docs.append((prose(rng.randint(0, 70), rng).split() + part + prose(rng.randint(0, 5), rng).split()))
    want = set()
    for d, w in enumerate(docs):
        for b, v in enumerate(items):
            for shift in range(-len(v), len(w) + 1):
                same = [0 <= i + shift < len(w) and w[i + shift] == x for i, x in enumerate(v)]
                if max(sum(same[i : i + 13]) for i in range(len(v) - 12)) >= 10:
                    want.add((d, b))
    frames = [spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(rows)], f"{key} long, text string") for key, rows in (("doc_id", docs), ("item_id", items))]
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated_pairs(*frames).collect()} == want


# 9


def brute_repeats(rows, length, short):
    data = [(t or "").encode() for t in rows]
    count = lambda n: Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    seen, brief = count(length), count(short)
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        repeats = any(brief[b[i : i + short]] > 1 for i in range(len(b) - short + 1))
        out.append((len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone, strict=True) if not g), repeats))
    return sorted(out)


def of_repeats(r):
    assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
    return (r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept), r.repeats)


def repeating_texts(seed, n):
    rng = random.Random(seed)
    passage = "".join(rng.choice("ab") for _ in range(90))
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 200))) + rng.choice(["", passage, passage[10:80], passage[:33]]) + "é" * rng.randint(0, 3) + rng.choice(["", "x" * 60, "xy\0" * 30, "\0" * rng.randint(1, 50)]) for _ in range(n)]
    return [*texts, texts[0], None, "", "a" * 100, passage + passage, "b" * 39, "xyz" * 200, "zxy" * 30, "lone " + "xyzw" * 12]


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"batch": 64}, {"hot": 1, "part": 50}, {"part": 37}])
def test_repeats_against_all_strings(spark, options):
    texts = repeating_texts(6, 60)
    d = spark.createDataFrame([(k % 50 if k != 7 else None, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(map(of_repeats, suffix_dedup.remove_repeats(d, 40, 30, 8, **options).collect()))
    assert got == brute_repeats(texts, 40, 30)


def test_repeat_edges(spark):
    d = edge_docs(spark)
    got = sorted(map(of_repeats, suffix_dedup.remove_repeats(d).collect()))
    assert got == brute_repeats([r.text for r in d.collect()], 400, 300)
    assert suffix_dedup.remove_repeats(d.limit(0)).count() == 0


def test_batches_added_one_after_another_to_a_kept_index(spark):
    texts, folder, spans, flags = repeating_texts(11, 40), None, {}, set()
    for a in range(0, len(texts), 13):
        family = suffix_dedup.IndexFamily(spark, folder, 40, 30, 8)
        folder = family.folder
        found, marks = family.add(spark.createDataFrame([(t,) for t in texts[a : a + 13]], "text string"))
        for r in suffix_dedup.removed(found, marks, 40, 30).join(found.select("t", "u", "text"), ["t", "u"]).collect():
            gone = spans.setdefault(r.text, set())
            for s in r.spans:
                gone.update(range(s.start, s.end))
            if r.repeats:
                flags.add(r.text)
        sizes = [x["size"] for x in family.levels]
        assert all(x >= 2 * y for x, y in zip(sizes, sizes[1:], strict=False))
        known = texts[: a + 13]
        want = dict(zip(known, [None] * len(known), strict=True))
        for t in want:
            b = (t or "").encode()
            rest = bytes(x for k, x in enumerate(b) if k not in spans.get(t, ()))
            want[t] = (len(b), len(b) - len(rest), rest, t in flags)
        assert sorted(want[t] for t in known) == sorted((x[0], x[1], x[3], x[4]) for x in brute_repeats(known, 40, 30))
    with pytest.raises(ValueError):
        suffix_dedup.IndexFamily(spark, folder, 41, 30, 8)


def test_a_long_run_of_one_byte_is_one_region_and_goes():
    data = np.full(300_000, 97, np.uint8)
    _, first, last, _, periodic, _, _ = suffix_dedup.regions(data, np.array([0, len(data)]), 400, 300, 32)
    assert first.tolist() == [0] and last.tolist() == [len(data) - 300] and periodic.all()
    kept = suffix_dedup.Regions(400, 300, 32)
    kept.add(1, 5, 6, 0, 0, len(data) - 300, True, data.tobytes())
    kept.search()
    gone = np.zeros(len(data), bool)
    for _, a, b in kept.marks:
        if a >= 0:
            gone[a : b + 400] = True
    assert gone.all()


@pytest.mark.parametrize("m", [2, 3, 10, 90, 200])
def test_extensions_dominate_those_of_all_pairs(m):
    rng = random.Random(m)
    ahead, behind = ([bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(m)] for _ in range(2))
    common = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    order, back = (sorted(range(m), key=x.__getitem__) for x in (ahead, behind))
    lcp = [[common(x[i], x[j]) for i, j in itertools.pairwise(o)] for x, o in ((ahead, order), (behind, back))]
    best = [set() for _ in range(m)]
    for i, j, left, right in suffix_dedup.extensions(order, lcp[0], back, lcp[1]):
        assert i != j and left == common(behind[i], behind[j]) and right <= common(ahead[i], ahead[j])
        for k in (i, j):
            best[k].add((left, right))
    for i in range(m):
        for j in range(m):
            want = (common(behind[i], behind[j]), common(ahead[i], ahead[j]))
            assert i == j or any(a >= want[0] and b >= want[1] for a, b in best[i])


# 10


def brute_runs(rows, depth):
    """rows (doc_id, text) without repeated ids."""
    seqs, first = {}, {}
    for d, t in sorted(rows):
        seqs[d] = [x for x in (t or "").split("\n") if x.strip(" ")] if t is not None else []
        for i in range(len(seqs[d]) - depth + 1):
            first.setdefault(tuple(seqs[d][i : i + depth]), (d, i))
    out = {}
    for d, t in rows:
        s = seqs[d]
        gone = {j for i in range(len(s) - depth + 1) if first[tuple(s[i : i + depth])] != (d, i) for j in range(i, i + depth)}
        k, kept = 0, []
        for x in (t or "").split("\n"):
            if x.strip(" "):
                if k not in gone:
                    kept.append(x)
                k += 1
            else:
                kept.append(x)
        out[d] = (None if t is None else "\n".join(kept), len(s), len(gone), sum(j - 1 not in gone for j in gone))
    return out


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 20])
def test_line_runs_against_brute_force(spark, depth):
    rng = random.Random(depth)
    rows = [(k, "\n".join(rng.choice(["a", "b", "c", "", " "]) for _ in range(rng.randint(0, 14)))) for k in range(80)] + [(80, None), (81, "")]
    long = [rng.choice("abcdefgh") for _ in range(60)]
    rows += [(90 + k, "\n".join(["x" * k, *long[k : 60 - k], "y" * k])) for k in range(9)]
    got = {r.doc_id: tuple(r)[1:] for r in line_runs.remove_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string"), depth).collect()}
    assert got == brute_runs(rows, depth)


def test_line_run_edges(spark):
    rows = [(None, "a\nb"), (1, "a\nb"), (1, "a\nb"), (1, "a\nb\nc"), (2, None)]
    d = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, k int")
    got = sorted(map(str, map(tuple, line_runs.remove_repeated_runs(d).collect())))
    assert got == sorted(map(str, [(None, "a\nb", 2, 0, 0), (1, "", 2, 2, 1), (1, "", 2, 2, 1), (1, "c", 3, 2, 1), (2, None, 0, 0, 0)]))
    assert line_runs.remove_repeated_runs(d.limit(0)).count() == 0


def test_texts_of_very_many_lines_take_time_in_proportion(spark):
    took = []
    for n in (10_000, 100_000):
        d = spark.createDataFrame([(k, "\n".join(f"line {j}" for j in range(n))) for k in range(2)], "doc_id long, text string")
        start = time.monotonic()
        got = sorted((r.doc_id, r.n_lines, r.n_removed, r.n_runs) for r in line_runs.remove_repeated_runs(d).collect())
        took.append(time.monotonic() - start)
        assert got == [(0, n, 0, 0), (1, n, n, 1)]
    assert took[1] < 10 * took[0] + 20


def test_later_copies_of_long_lines_go(spark):
    long, short = " ".join(WORDS[:51]), " ".join(WORDS[:50])
    rows = [(1, long), (2, f"a\n{long}\nb"), (3, short), (4, f"c\n{short}"), (5, f"{long}\n\n{long}"), (6, f"a\n{long}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in line_runs.remove_repeated_runs(d, long_words=50).collect()}
    assert got == {1: (long, 1, 0, 0), 2: ("a\nb", 3, 1, 1), 3: (short, 1, 0, 0), 4: (f"c\n{short}", 2, 0, 0), 5: ("", 2, 2, 1), 6: ("", 2, 2, 1)}


# Pipeline


def test_pipeline_against_brute_force(spark):
    """run() as a whole: what is written is what plain Python keeps of the documents, in the mix that SQL gives."""
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    got = cp.run(spark, SMALL).collect()
    docs = [r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect() if r.text and any(map(str.isalpha, r.text))]
    least = {d for d, _, c in brute_components([(r.doc_id, r.text) for r in docs]) if d == c}
    items = [re.findall(r"[^\W_]+", r.text.lower()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    place = {}
    for k, v in enumerate(items):
        for j, w in enumerate(v):
            place.setdefault(w, []).append((k, j))

    def contaminated(text):
        diagonals = Counter((k, i - j) for i, w in enumerate(re.findall(r"[^\W_]+", text.lower())) for k, j in place.get(w, ()))
        words = re.findall(r"[^\W_]+", text.lower())
        for (k, shift), n in diagonals.items():
            if n >= 10:
                same = [0 <= j + shift < len(words) and words[j + shift] == w for j, w in enumerate(items[k])]
                if any(sum(same[a : a + 13]) >= 10 for a in range(len(same) - 12)):
                    return True
        return False

    kept = [r for r in docs if r.doc_id in least and not contaminated(r.text)]
    c = duckdb.connect()
    c.register("documents", pa.table({"doc_id": [r.doc_id for r in kept], "source": [r.source for r in kept], "text": [r.text for r in kept]}))
    uses = {d: taken // size if size else 0 for d, size, _, _, taken in c.sql(mixing.SQL).fetchall()}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, start = [], 0
    for r in sorted(kept, key=lambda r: r.doc_id):
        ids = np.array([*t.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        for _ in range(uses[r.doc_id]):
            want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
    assert sorted(map(tuple, got)) == want and len(want) > 100


def test_language_stage_writes_its_decision(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = cp.language_id(spark, docs, SMALL)
    assert kept.columns == docs.columns
    both = kept.select("doc_id", F.col("lang").alias("now")).join(docs, "doc_id").where("lang is not null")
    assert both.agg(F.avg((F.col("now") == F.col("lang")).cast("double"))).first()[0] > 0.95 and kept.where("lang is null").count() == 0


def test_pipeline_edges(spark):
    import corpus_pipeline as cp

    bench = SMALL
    for d in (edge_docs(spark), edge_docs(spark).limit(0)):
        for _, stage in cp.STAGES:
            d = stage(spark, d, bench).cache()
            d.count()


def test_texts_that_share_an_id_are_documents_of_their_own(spark):
    import corpus_pipeline as cp

    rng = random.Random(77)
    a, b, c = (prose(60, rng) for _ in range(3))
    near = " ".join([*b.split()[:-1], "changed"])
    rows = [(1, near), (2, a), (2, b), (2, a), (3, c), (4, c), (5, a + " end"), (None, a)]
    d = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)
    got = cp.near_duplicates(spark, d, SMALL)
    assert got.columns == d.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(0, a), (1, near), (2, a), (3, c)])
