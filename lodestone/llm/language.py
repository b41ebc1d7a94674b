"""Language identification with error-correcting output codes.

Each language has a codeword; one binary n-gram classifier per bit predicts that bit of a text's codeword, and the language
with the least loss, weighted by how well each classifier does on each language, is chosen. Classifiers are logistic
models over hashed byte n-grams of whole lower-cased texts, fitted in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.arrow import held_out, map_batches, table

#: Labelled rows that the classifiers are fitted on, about so many in all and as many of each language, but LEAST_EACH of each at
#: least where it has them. A row reaches the driver as WIDTH shares, however long its text is.
SAMPLE, LEAST_EACH = 2_000, 20
#: Hashed features (2 and 3 bytes long).
WIDTH = 1 << 13
#: A text is flagged as ambiguous where the second-best language's share of the score is over this.
AMBIGUOUS = 0.35
#: Texts whose rows of WIDTH features are held at once: 16 MB.
ROWS = 256
UNKNOWN = "und"
_LETTERS = np.zeros(256, np.uint32)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 256)


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, row after the last, matrix) for blocks of ROWS texts at most: square roots of n-gram shares, so each row has length 1 or 0."""
    for first, after, buf, off in tb.blocks(pc.utf8_lower(column.cast(pa.string()))):
        for lo in range(0, after - first, ROWS):
            hi = min(lo + ROWS, after - first)
            yield first + lo, first + hi, _matrix(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


def _matrix(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = len(off) - 1
    code = _LETTERS[buf]
    row = np.repeat(np.arange(n, dtype=np.int64) * WIDTH, np.diff(off))
    total = np.zeros(n * WIDTH)
    for k in (2, 3):
        if len(buf) < k:
            continue
        h, some = code[: len(code) - k + 1].copy(), code[: len(code) - k + 1] > 0
        for j in range(1, k):
            tail = code[j : len(code) - k + 1 + j]
            h = h * np.uint32(0x01000193) + tail
            some |= tail > 0
        h = (h * np.uint32(0x9E3779B1) + np.uint32(k)) >> np.uint32(19)
        some &= row[: len(h)] == row[k - 1 :]
        total += np.bincount(row[: len(h)][some] + h[some], minlength=n * WIDTH)
    x = np.sqrt(total.reshape(n, WIDTH))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return x.astype(np.float32)


def codewords(classes: int, seed: int = 17) -> np.ndarray:
    """A row of -1 and 1 for each class: all splits of the classes where they are few, else random columns that keep rows far apart."""
    if classes <= 7:
        bits = 2 ** max(classes - 1, 0) - 1
        return np.array([[1 if c == 0 or not (b + 1) >> (c - 1) & 1 else -1 for b in range(bits)] for c in range(classes)], np.int8).reshape(classes, bits)
    rng, bits = np.random.default_rng(seed), 15 * int(np.ceil(np.log2(classes)))
    best, far = None, -1
    for _ in range(50):
        code = rng.choice(np.array([-1, 1], np.int8), (classes, bits))
        gap = code.astype(np.int32) @ code.T.astype(np.int32)
        near = int((bits - gap[~np.eye(classes, dtype=bool)]).min())
        if near > far and (np.abs(code.sum(0)) < classes).all():
            best, far = code, near
    return best


@dataclass
class Codes:
    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def shares(self, x: np.ndarray) -> np.ndarray:
        """A row of shares over the languages for each text: softmax of minus the weighted loss."""
        margin = x @ self.weight + self.bias
        loss = np.stack([(np.logaddexp(0, -margin * c) * t).sum(1) for c, t in zip(self.code, self.trust, strict=True)], 1)
        e = np.exp(-(loss - loss.min(1, keepdims=True)) * max(1, self.code.shape[1]))
        return e / e.sum(1, keepdims=True)


def fit_codes(x: np.ndarray, lang: list[str], steps: int = 250, ridge: float = 1e-5, rate: float = 40.0) -> Codes:
    languages = sorted(set(lang))
    y = np.array([languages.index(v) for v in lang], np.int64)
    code = codewords(len(languages))
    bits = code.shape[1]
    target = code[y].astype(np.float32) if len(y) else np.zeros((0, bits), np.float32)
    weight, bias = np.zeros((WIDTH, bits), np.float32), np.zeros(bits, np.float32)
    ahead, was = weight.copy(), weight
    for k in range(steps if bits and len(y) else 0):
        slope = -target / (1 + np.exp(target * (x @ ahead + bias)))
        weight = ahead - rate * (x.T @ slope / len(y) + ridge * ahead)
        bias = bias - slope.mean(0)
        ahead, was = weight + k / (k + 3) * (weight - was), weight
    right = (target * (x @ weight + bias) > 0).astype(float)
    trust = np.stack([right[y == c].mean(0) for c in range(len(languages))]) + 1e-3 if bits else np.ones((len(languages), 0))
    return Codes(languages, code, weight, bias, trust / trust.sum(1, keepdims=True) if bits else trust)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Codes:
    """Learns from text and non-null lang of rows that are not held out. No such rows: a model without languages.

    Every language is learned, from whole texts. The driver holds the distinct labels and, above sample / LEAST_EACH of them, LEAST_EACH rows of each.
    Null texts and those without a letter teach nothing; repeated rows count as often as they occur.
    """
    rows = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("text").isNotNull()).where(F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not there:
        return fit_codes(np.zeros((0, WIDTH), np.float32), [])
    each = max(LEAST_EACH, sample / len(there))
    line = F.create_map(*(F.lit(v) for lang, n in sorted(there.items()) for v in (lang, int(min(1.0, each / n) * (1 << 30)))))
    # A language of few rows is taken whole, so that chance leaves none out.
    chosen = rows.where((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < line[F.col("lang")]))

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, x in features(batch.column(2)):
            yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], ["doc_id", "lang", "x"])

    got = map_batches(chosen, one, "doc_id long, lang string, x binary").toArrow().sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float16).reshape(-1, WIDTH).astype(np.float32)
    return fit_codes(x, got.column("lang").to_pylist())


def predict(docs: DataFrame, model: Codes) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of each row; `und` with score 0 where text is null or has no letter.

    Of languages with equal losses the first by name is chosen. Repeated rows are predicted alike, whole texts however long they are.
    """
    languages = pa.array([*model.languages, UNKNOWN])

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sure = batch.column("letters").to_numpy(zero_copy_only=False)
        for lo, hi, x in features(batch.column("text")):
            known = sure[lo:hi] & bool(model.languages)
            if model.languages:
                p = model.shares(x)
                first, score = p.argmax(1), p.max(1)
                second = np.sort(p, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
            else:
                first, score, second = (np.zeros(hi - lo, t) for t in (int, float, float))
            pick = np.where(known, first, len(model.languages))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], batch.column("held_out")[lo:hi], languages.take(pa.array(pick)), pa.array(np.where(known, score, 0.0)), pa.array(known & (second > AMBIGUOUS))],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return map_batches(seen, one, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def op3_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
