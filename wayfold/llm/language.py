"""Operator 1: language identification by error-correcting output codes.

Each language has a codeword; for each bit a binary n-gram classifier (log odds of hashed character n-grams, each side
the mean of its languages) says which side of the split a text is on. Decoding weighs the loss of each bit by how well
its classifier does on the codeword's language, and takes the codeword of least weighted loss. A second codeword nearly
as close flags the text as ambiguous.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bound_batches, slices, written

#: Distinct texts of a language in the fitting sample, about; chosen by a hash of the text. One in TRUST_FOLD of them is kept
#: from the classifiers and says how far each is to be trusted, where a language has at least FEW texts.
FIT_DOCUMENTS, TRUST_FOLD, FEW = 2_000, 5, 50
#: Languages that a model may have.
MOST_LANGUAGES = 1_000
SPACE_BITS = 15
ORDERS = (1, 2, 3)
#: A text is ambiguous if the second best codeword has more than this share of the best one's weight.
AMBIGUOUS = 0.5
UNKNOWN = "und"

_FOLD = None


def _letters() -> np.ndarray:
    """Code point to itself if it is a letter, else to a blank."""
    global _FOLD
    if _FOLD is None:
        _FOLD = np.array([c if chr(c).isalpha() else 32 for c in range(0x32000)], np.uint32)
    return _FOLD


def _grams(texts: list[str]):
    """Yield (rows a, b, ids, bound) per piece of texts: hashed n-grams of text k are ids[bound[k - a]:bound[k - a + 1]]."""
    lengths = np.r_[0, np.cumsum([len(t) + 2 for t in texts])]
    for a, b in slices(lengths, 1 << 18):
        # lower() can lengthen a text, so offsets are taken after it.
        low = [" " + t.lower() + " " for t in texts[a:b]]
        bound = np.r_[0, np.cumsum([len(t) for t in low])]
        code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
        table = _letters()
        code = np.where(code < len(table), table[np.minimum(code, len(table) - 1)], code).astype(np.uint32)
        ids, keep = [], []
        n = len(code)
        for order in ORDERS:
            h = np.full(n, order, np.uint32)
            blank = np.ones(n, bool)
            for j in range(order):
                c = np.full(n, 32, np.uint32)
                c[: n - j] = code[j:]
                h = (h ^ c) * np.uint32(0x01000193)
                blank &= c == 32
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            ids.append((h >> np.uint32(32 - SPACE_BITS)).astype(np.int32))
            keep.append(~blank)
        # An n-gram that runs over a text's end starts in its last blank or holds the next text's first blank only.
        ids, keep = np.stack(ids, 1).ravel(), np.stack(keep, 1).ravel()
        count = np.r_[0, np.cumsum(keep)]
        yield a, b, ids[keep], count[bound * len(ORDERS)]


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1, far apart in pairs: all splits for up to 6 languages, else the best of seeded draws."""
    if n == 1:
        return np.ones((1, 1), np.int8)
    if n <= 6:
        splits = [s for s in product((1, -1), repeat=n) if s[0] == 1 and -1 in s]
        return np.array(splits, np.int8).T
    bits, rng, best, gap = int(np.ceil(10 * np.log2(n))), np.random.default_rng(n), None, -1
    for _ in range(50):
        draw = rng.choice(np.array([1, -1], np.int8), (n, bits))
        draw[:, np.abs(draw.sum(0)) == n] *= np.where(np.arange(n) % 2, 1, -1).astype(np.int8)[:, None]
        worst = ((bits - draw.astype(np.int32) @ draw.T) // 2 + bits * np.eye(n, dtype=np.int32)).min()
        if worst > gap:
            best, gap = draw, worst
    return best


class Model:
    """languages, code (language x bit), weights (n-gram x bit) and trust (language x bit)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        self.weights = np.zeros((counts.shape[1], self.code.shape[1]), np.float32)
        for b in range(self.code.shape[1]):
            plus, minus = self.code[:, b] > 0, self.code[:, b] < 0
            if minus.any() and plus.any():
                self.weights[:, b] = np.log(share[plus].mean(0)) - np.log(share[minus].mean(0))
        self.trust = np.full(self.code.shape, 1 / self.code.shape[1])

    def margins(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(margins text x bit, letters): evidence of each binary classifier, damped for long texts."""
        out, letters = np.zeros((len(texts), self.code.shape[1]), np.float32), np.zeros(len(texts), np.int64)
        for a, b, ids, bound in _grams(texts):
            n = np.diff(bound)
            full = np.flatnonzero(n)
            if len(full):
                out[a + full] = np.add.reduceat(self.weights[ids], bound[:-1][full], axis=0) / (1 + np.sqrt(n[full]))[:, None]
            letters[a:b] = n
        return out, letters

    def fit_trust(self, right: np.ndarray, seen: np.ndarray) -> None:
        """Weigh each bit of a codeword by its classifier's accuracy above chance on that language."""
        good = np.maximum((right + 1) / (seen[:, None] + 2) - 0.5, 1e-3)
        self.trust = good / good.sum(1, keepdims=True)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score 0 to 1, ambiguous) from the weighted logistic loss of each codeword."""
        loss = np.stack([(np.logaddexp(0, -2 * margins * c) * t).sum(1) for c, t in zip(self.code, self.trust, strict=True)], 1)
        weight = np.exp(-2 * (loss - loss.min(1, keepdims=True)))
        weight /= weight.sum(1, keepdims=True)
        best = weight.argmax(1)
        score = weight[np.arange(len(best)), best]
        second = np.sort(weight, 1)[:, -2] if weight.shape[1] > 1 else np.zeros(len(best))
        return best, score, second > AMBIGUOUS * score


def fit(rows: DataFrame, most: int = FIT_DOCUMENTS) -> Model | None:
    """A model from rows(text, lang); rows without text, letters or lang teach nothing. None if nothing is left.

    About `most` distinct texts of each language, by a hash of the text, are written once as the sample, so that copies
    count once and every language with a text is taught. The n-gram counts of the languages and the hits of each
    classifier on texts it was not fitted on come back as one small table each.
    """
    bound_batches(rows.sparkSession)
    rows = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("h"))
    sizes = sorted(tuple(r) for r in rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02)).take(MOST_LANGUAGES + 1))
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return None
    share = F.create_map(*[F.lit(v) for x, n in sizes for v in (x, min(1.0, most / n))])
    # The hash decides before anything looks at the text.
    sample = rows.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003).where(r"text rlike '\\p{L}'").dropDuplicates(["lang", "h"])
    sample = written(sample, "language-sample")
    taught = {r.lang: r["count"] for r in sample.groupBy("lang").count().collect()}
    if not taught:
        return None
    languages = sorted(taught)
    few = F.col("lang").isin([x for x, n in taught.items() if n < FEW])
    fold = F.pmod(F.xxhash64(F.lit(1), "h"), F.lit(TRUST_FOLD)) == 0
    sample, judged = sample.where(few | ~fold), sample.where(few | fold)
    place = {x: k for k, x in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), 1 << SPACE_BITS), np.int64)
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, _, ids, bound in _grams(texts):
                for k in range(len(bound) - 1):
                    total[place[langs[a + k]]] += np.bincount(ids[bound[k] : bound[k + 1]], minlength=1 << SPACE_BITS)
        k = np.flatnonzero(total.any(1))
        yield pa.record_batch([pa.array([languages[i] for i in k], pa.string()), pa.array([total[i].tobytes() for i in k], pa.binary())], ["lang", "n"])

    counts = np.zeros((len(languages), 1 << SPACE_BITS), np.int64)
    for r in sample.mapInArrow(count, "lang string, n binary").toLocalIterator():
        counts[place[r.lang]] += np.frombuffer(r.n, np.int64)
    model = Model(languages, counts)

    def hits(batches):
        right, seen = np.zeros(model.code.shape, np.int64), np.zeros(len(languages), np.int64)
        for batch in batches:
            margins, letters = model.margins(batch.column("text").to_pylist())
            at = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            np.add.at(right, at, (margins * model.code[at] > 0).astype(np.int64))
            np.add.at(seen, at, 1)
        yield pa.record_batch([pa.array([right.tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], ["right", "seen"])

    right, seen = np.zeros(model.code.shape, np.int64), np.zeros(len(languages), np.int64)
    for r in judged.mapInArrow(hits, "right binary, seen binary").toLocalIterator():
        right += np.frombuffer(r.right, np.int64).reshape(right.shape)
        seen += np.frombuffer(r.seen, np.int64)
    model.fit_trust(right, seen)
    return model


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and ambiguous for every row; input columns of these names are replaced.

    A null text or one without a letter is `und` with score 0; so is every text if there is no model.
    """
    bound_batches(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    docs = docs.select(*names)
    schema = StructType(list(docs.schema)).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            if model is None:
                best, score, ambiguous, known = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), bool), np.zeros(len(texts), bool)
            else:
                margins, _ = model.margins(texts)
                best, score, ambiguous = model.decode(margins)
                known = np.array([any(map(str.isalpha, t)) for t in texts], bool)
            pred = [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, known, strict=True)]
            arrays = [*batch.columns, pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0), pa.float64()), pa.array(ambiguous & known)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "lang_pred", "score", "ambiguous"])

    return docs.mapInArrow(run, schema)


def held_out(doc_id=None):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous): fitted on the rows that are not held out, predicted for all.

    held_out is crc32(doc_id as text) mod 3 = 1, false for a null id. A null text or one without a letter is `und` with
    score 0, and so is every text if no row teaches. Repeated rows give equal rows; a very long text is read whole, in
    pieces; other columns are ignored; an empty table gives no rows.
    """
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """All of documents."""
    return predict(spark.read.parquet(f"{sf_dir}/documents.parquet"))
