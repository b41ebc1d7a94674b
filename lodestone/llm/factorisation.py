"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the product of two short vectors; the sum over all pairs is half of the square of the sum less the
sum of the squares, by factor, so a text is scored in time that follows its distinct words. The machine is fitted in numpy on a
bounded sample of labelled rows and has one size whatever the corpus, so it travels inside the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.arrow import map_batches, table
from lodestone.llm.quality import FEATURES, bounded_sample, statistics

#: Labelled rows that the machine is fitted on, at most about so many. A row reaches the driver in 4 bytes a hashed word that it has,
#: 4 * WIDTH at most.
SAMPLE = 8_000
#: Hashed words, and length of a feature's vector.
WIDTH, RANK = 1 << 13, 8
#: What the metadata say: the logarithm of the stated length, whether there is one, and how far it is from the text's.
META = ("log_stated", "no_length", "length_gap")
DENSE = (*FEATURES, *META)
#: Standard deviations beyond which a dense feature counts no further.
CLIP = 4.0


@dataclass
class Features:
    """Of rows: hashed words as (start of each row, word, weight), weights of length 1 a row, and dense features."""

    start: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    dense: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.start) - 1), np.diff(self.start))

    def take(self, rows: np.ndarray) -> Features:
        size = np.diff(self.start)[rows]
        start = np.concatenate(([0], np.cumsum(size)))
        at = np.arange(start[-1]) + np.repeat(self.start[:-1][rows] - start[:-1], size)
        return Features(start, self.word[at], self.weight[at], self.dense[rows])


def features(buf: np.ndarray, off: np.ndarray, stated: np.ndarray) -> Features:
    """Of a block of texts; stated: lengths that the metadata give, nan where they give none."""
    starts, ends, rows = tb.runs(tb.WORD[buf], off)
    n = len(off) - 1
    h = (tb.hashes(tb.prefix(buf), starts, ends) >> np.uint64(40)).astype(np.int64) % WIDTH
    key, count = np.unique(np.repeat(np.arange(n), np.diff(rows)) * WIDTH + h, return_counts=True)
    row = key // WIDTH
    norm = np.sqrt(np.bincount(row, count, n))
    start = np.searchsorted(row, np.arange(n + 1))
    stat = statistics(buf, off)
    chars = tb.sums_by_row((buf & 0xC0) != 0x80, off)
    none = np.isnan(stated)
    said = np.log1p(np.maximum(np.where(none, chars, stated), 0))
    dense = np.stack([*(stat[f] for f in FEATURES), said, none, np.abs(said - np.log1p(chars))], 1)
    return Features(start, key % WIDTH, np.sqrt(count) / norm[row], dense)


@dataclass
class Machine:
    """bias + sum of linear * x + sum over pairs i < j of (factors i . factors j) * x i * x j; hashed words come before dense features."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.mean) / self.spread, -CLIP, CLIP) / CLIP

    def sums(self, x: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scaled dense features, sum of factor * x, sum of its square) by row and factor."""
        z, row, n = self.scaled(x.dense), x.row, len(x.start) - 1
        f, g = self.factors[:WIDTH], self.factors[WIDTH:]
        one, two = z @ g, z**2 @ g**2
        for k in range(f.shape[1]):
            part = f[x.word, k] * x.weight
            one[:, k] += np.bincount(row, part, n)
            two[:, k] += np.bincount(row, part**2, n)
        return z, one, two

    def raw(self, x: Features) -> np.ndarray:
        z, one, two = self.sums(x)
        own = self.bias + z @ self.linear[WIDTH:] + np.bincount(x.row, self.linear[x.word] * x.weight, len(z))
        return own + (one**2 - two).sum(1) / 2

    def score(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -500, 500)))


def fit_machine(x: Features, y: np.ndarray, rounds: int = 12, batch: int = 128, rate: float = 0.1, ridge: float = 1e-5, seed: int = 5) -> Machine:
    """Log loss by AdaGrad over small batches, the same for the same rows. Without rows: score 0.5 for all."""
    rng, n = np.random.default_rng(seed), len(y)
    size = WIDTH + x.dense.shape[1]
    mean, spread = (x.dense.mean(0), x.dense.std(0) + 1e-6) if n else (np.zeros(x.dense.shape[1]), np.ones(x.dense.shape[1]))
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3) if n else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, RANK)) if n else np.zeros((size, RANK)), mean, spread)
    seen_b, seen_w, seen_f = 1e-8, np.full(size, 1e-8), np.full((size, RANK), 1e-8)
    for _ in range(rounds):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            rows = order[lo : lo + batch]
            part = x.take(rows)
            z, one, two = m.sums(part)
            own = m.bias + z @ m.linear[WIDTH:] + np.bincount(part.row, m.linear[part.word] * part.weight, len(rows)) + (one**2 - two).sum(1) / 2
            slope = (1 / (1 + np.exp(-np.clip(own, -500, 500))) - y[rows]) / len(rows)
            pull = slope[part.row] * part.weight
            used = np.unique(part.word)
            at = np.searchsorted(used, part.word)
            grad_w = np.concatenate((np.bincount(at, pull, len(used)), slope @ z))
            square = np.bincount(at, pull * part.weight, len(used))
            grad_f = np.stack([np.bincount(at, pull * one[part.row, k], len(used)) for k in range(RANK)], 1) - m.factors[used] * square[:, None]
            grad_f = np.concatenate((grad_f, (z * slope[:, None]).T @ one - m.factors[WIDTH:] * (slope @ z**2)[:, None]))
            touched = np.concatenate((used, np.arange(WIDTH, size)))
            grad_w += ridge * m.linear[touched]
            grad_f += ridge * m.factors[touched]
            seen_b += slope.sum() ** 2
            seen_w[touched] += grad_w**2
            seen_f[touched] += grad_f**2
            m.bias -= rate * slope.sum() / np.sqrt(seen_b)
            m.linear[touched] -= rate * grad_w / np.sqrt(seen_w[touched])
            m.factors[touched] -= rate / 2 * grad_f / np.sqrt(seen_f[touched])
    return m


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the third of the documents that the machine does not learn from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def _stated(batch: pa.RecordBatch, lo: int, hi: int) -> np.ndarray:
    return batch.column("n_chars")[lo:hi].cast(pa.float64()).to_numpy(zero_copy_only=False)


def sample(docs: DataFrame, labels: DataFrame, learned: Column, rows: int = SAMPLE) -> tuple[Features, np.ndarray, np.ndarray]:
    """(features, quality, doc_id) of labelled documents, about `rows` at most, in an order that does not depend on how they were dealt.

    Null labels don't count, of several labels of a document the lowest does, and of a repeated document one row.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = bounded_sample(known.where(learned), rows)  # so few rows that they are sent to all tasks
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(chosen), "doc_id")

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, buf, off in tb.blocks(batch.column("text")):
            x = features(buf, off, _stated(batch, lo, hi))
            cut = lambda v, kind: pa.array([v[a:b].astype(kind).tobytes() for a, b in zip(x.start[:-1], x.start[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")[lo:hi], batch.column("quality")[lo:hi].cast(pa.float64()), cut(x.word, np.uint16), cut(x.weight, np.float16), pa.array([v.tobytes() for v in x.dense], pa.binary())],
                ["doc_id", "quality", "word", "weight", "dense"],
            )

    found = map_batches(both, one, "doc_id long, quality double, word binary, weight binary, dense binary").groupBy("doc_id").agg(F.min(F.struct("quality", "word", "weight", "dense")).alias("x"))
    got = found.select("doc_id", "x.*").toArrow().sort_by("doc_id")
    word = got.column("word").to_pylist()
    start = np.concatenate(([0], np.cumsum([len(w) // 2 for w in word], dtype=np.int64)))
    flat = lambda c, kind: np.frombuffer(b"".join(got.column(c).to_pylist()), kind)
    x = Features(start, flat("word", np.uint16).astype(np.int64), flat("weight", np.float16).astype(float), flat("dense", float).reshape(-1, len(DENSE)))
    return x, got.column("quality").to_numpy(), got.column("doc_id").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Machine:
    """Learns `quality` from documents that are not held out. No such rows: a machine that says 0.5."""
    x, y, _ = sample(docs, labels, ~held_out(), rows)
    return fit_machine(x, y)


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of each row.

    Null and empty texts have no words and are scored by their statistics and stated length; whole texts are read, however long; repeated rows are
    scored alike; an empty table gives an empty one. Only doc_id, text and n_chars are read; doc_id is no feature.
    """

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, buf, off in tb.blocks(batch.column("text")):
            p = machine.score(features(buf, off, _stated(batch, lo, hi)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")[lo:hi], batch.column("held_out")[lo:hi], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text", F.col("n_chars").cast("long").alias("n_chars"))
    return map_batches(seen, one, "doc_id long, held_out boolean, score double, predicted int")


def op12_factorisation(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
