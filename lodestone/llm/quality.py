"""Quality rules: fixed base rules over document statistics, then gradient-boosted trees.

Statistics are taken from whole texts in one pass of numpy over bytes. The trees are fitted in numpy on a bounded
sample of labelled rows and flattened into arrays of nodes, so a batch is scored one tree level at a time. Chosen features may
only push the score one way (more repetition or more symbols never raise it).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.arrow import held_out, map_batches, stored, table

#: Labelled rows that the trees are fitted on, at most about so many; further rows are sampled by a hash of doc_id.
SAMPLE = 20_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(3))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_STOP[list(b".,;:?!")] = True
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Ratios that the trees see, with the direction in which each may move the score: -1 down, 1 up, 0 either.
FEATURES = {
    "log_words": 0, "word_length": 0, "symbols_per_char": -1, "dup_lines_ratio": -1, "repeat_words_ratio": -1,
    "upper_ratio": -1, "digit_ratio": 0, "bang_ratio": -1, "pipe_ratio": -1, "stop_ratio": 0, "words_per_line": 0,
    "distinct_ratio": 1, "symbol_ended_ratio": -1, "longest_run_ratio": -1,
}
STATS = ", ".join([*(f"{n} long" for n in BASE), *(f"{n} double" for n in FEATURES)])


def _count_repeats(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True for each hash that its row holds more than once."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((h, row))
    a, r = h[order], row[order]
    same = (a[1:] == a[:-1]) & (r[1:] == r[:-1])
    out = np.zeros(len(h), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def statistics(buf: np.ndarray, off: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts and FEATURES of each text of a block."""
    n = len(off) - 1
    word = tb.WORD[buf]
    starts, ends, rows = tb.runs(word, off)
    sums = tb.prefix(buf)
    h = tb.hashes(sums, starts, ends)
    n_words = np.diff(rows)
    lead = (buf & 0xC0) != 0x80
    chars = np.concatenate(([0], np.cumsum(lead)))
    word_chars = tb.sums_by_row(lead & word, off)
    symbols = tb.sums_by_row(_SYMBOL[buf], off)

    grams, edge = tb.ngrams(h, rows, 3)
    again = np.flatnonzero(_count_repeats(grams, edge))
    at = again + np.repeat(rows[:-1] - edge[:-1], np.diff(edge))[again] if len(again) else again
    covered = np.zeros(len(h) + 2, bool)
    for k in range(3):
        covered[at + k] = True
    repeat = tb.sums_by_row(covered[: len(h)], rows)

    lo, hi, lines = tb.runs(buf != 0x0A, off)
    words_before = np.concatenate(([0], np.cumsum(word)))
    has_word = words_before[hi] > words_before[lo]
    full = np.concatenate(([0], np.cumsum(has_word)))[lines]
    lh = tb.hashes(sums, lo[has_word], hi[has_word])
    row = np.repeat(np.arange(n), np.diff(full))
    order = np.lexsort((lh, row))
    earlier = np.zeros(len(lh), bool)
    earlier[1:] = (lh[order][1:] == lh[order][:-1]) & (row[order][1:] == row[order][:-1])
    dup = np.bincount(row[order][earlier], minlength=n).astype(np.int64)

    word_row = np.repeat(np.arange(n), n_words)
    order = np.lexsort((h, word_row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (word_row[order][1:] != word_row[order][:-1])
    distinct = np.bincount(word_row[order][fresh], minlength=n)
    same_as_last = np.zeros(len(h), bool)
    same_as_last[1:] = (h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])
    ended = _SYMBOL[buf[ends - 1]] | (buf[ends - 1] == 0x21) if len(ends) else np.zeros(0, bool)

    per_word, per_char = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    stat = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat}
    stat |= {
        "log_words": np.log1p(n_words), "word_length": word_chars / per_word, "symbols_per_char": symbols / per_char,
        "dup_lines_ratio": dup / np.maximum(np.diff(full), 1), "repeat_words_ratio": repeat / per_word,
        "upper_ratio": tb.sums_by_row(_UPPER[buf], off) / per_char, "digit_ratio": tb.sums_by_row(_DIGIT[buf], off) / per_char,
        "bang_ratio": tb.sums_by_row(buf == 0x21, off) / per_word, "pipe_ratio": tb.sums_by_row(buf == 0x7C, off) / per_word,
        "stop_ratio": tb.sums_by_row(_STOP[buf], off) / per_word, "words_per_line": n_words / np.maximum(np.diff(full), 1),
        "distinct_ratio": distinct / per_word, "symbol_ended_ratio": tb.sums_by_row(ended, rows) / per_word,
        "longest_run_ratio": tb.sums_by_row(same_as_last, rows) / per_word,
    }
    return stat


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id with the base counts and FEATURES of each whole text; null and empty texts: zeros."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, buf, off in tb.blocks(batch.column(1)):
            stat = statistics(buf, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[lo:hi], *(pa.array(stat[n].astype(np.int64)) for n in BASE), *(pa.array(stat[n].astype(np.float64)) for n in FEATURES)],
                ["doc_id", *BASE, *FEATURES],
            )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), one, f"doc_id long, {STATS}")


@dataclass
class Trees:
    """Complete binary trees of one depth, a row of node arrays each: node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    bias: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - (2**depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, direction: list[int], trees: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 2.0) -> Trees:
    """Boosted trees for log loss. A split on a directed feature that would order its children the other way is not taken, and
    the midpoint of its children bounds all leaves below them, which keeps every tree monotone in it."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)] if n else [np.zeros(1)] * width
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(width)], 1) if n else np.zeros((0, width), np.int64)
    share = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    raw = np.full(n, bias)
    for k in range(trees if n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        bound = {0: (-np.inf, np.inf)}
        for at in range(inner):
            inside = np.flatnonzero(node == at)
            lo, hi = bound[at]
            best, choice = 1e-3, None
            if len(inside) >= 20:
                gs, hs = g[inside], h[inside]
                total_g, total_h = gs.sum(), hs.sum()
                for j in range(width):
                    b = binned[inside, j]
                    gl = np.cumsum(np.bincount(b, gs, len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, hs, len(cuts[j]) + 1))[:-1]
                    gr, hr = total_g - gl, total_h - hl
                    vl, vr = np.clip(-gl / (hl + ridge), lo, hi), np.clip(-gr / (hr + ridge), lo, hi)
                    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - total_g**2 / (total_h + ridge)
                    gain[(hl < 1) | (hr < 1) | (direction[j] * (vr - vl) < 0)] = 0
                    if len(gain) and gain.max() > best:
                        c = int(gain.argmax())
                        best, choice = float(gain[c]), (j, c, float(vl[c]), float(vr[c]))
            left, right = (lo, hi), (lo, hi)
            if choice:
                j, c, vl, vr = choice
                feature[k, at], threshold[k, at] = j, cuts[j][c]
                node[inside] = 2 * at + 1 + (binned[inside, j] > c)
                mid = (vl + vr) / 2
                if direction[j]:
                    left, right = ((lo, mid), (mid, hi)) if direction[j] > 0 else ((mid, hi), (lo, mid))
            else:
                node[inside] = 2 * at + 1
            bound[2 * at + 1], bound[2 * at + 2] = left, right
        for q in range(leaves):
            inside = node == q + inner
            lo, hi = bound[q + inner]
            value = float(np.clip(-g[inside].sum() / (h[inside].sum() + ridge), lo, hi))
            leaf[k, q] = rate * value
        raw += leaf[k][node - inner]
    return Trees(feature, threshold, leaf, bias)


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """All rows where there are at most `rows`, else about as many, chosen by a hash of the key."""
    there = df.count()
    return df if there <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(rows / there * (1 << 30)))


def sampled_labels(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, quality) that trees are fitted on: not held out, about `sample` rows at most, chosen by a hash of the id.

    Rows with a null label don't count; of several labels of a document the lowest does.
    """
    known = labels.where(F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where(~held_out())
    return bounded_sample(known, sample)


def fit(stats: DataFrame, chosen: DataFrame) -> Trees:
    """Trees for `quality` = 1 from the statistics of the rows with a chosen label (about SAMPLE rows, which are broadcast)."""
    rows = stats.join(F.broadcast(chosen), "doc_id").select("quality", *FEATURES).toPandas()
    # the fit does not depend on how rows were dealt
    order = np.lexsort(np.column_stack((rows[list(FEATURES)].to_numpy(float), rows["quality"].to_numpy(float))).T)
    return fit_trees(rows[list(FEATURES)].to_numpy(float)[order], rows["quality"].to_numpy(float)[order], list(FEATURES.values()))


def apply_rules(stats: DataFrame, trees: Trees, least: float = 0.5) -> DataFrame:
    """Adds base_failed, score and kept."""
    schema = f"doc_id long, {', '.join(f'{n} long' for n in BASE)}, base_failed boolean, kept boolean, score double"

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        col = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*BASE, *FEATURES)}
        score = trees.score(np.stack([col[n] for n in FEATURES], 1))
        failed = (col["n_words"] < 50) | (100 * col["n_repeat_words"] > 50 * col["n_words"])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(batch.column(n) for n in BASE), pa.array(failed), pa.array(~failed & (score >= least)), pa.array(score)],
            ["doc_id", *BASE, "base_failed", "kept", "score"],
        )

    return map_batches(stats, one, schema)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and score of every row of docs.

    A repeated row is judged as often as it occurs. Without labelled rows the trees keep what the base rules keep. Null and empty texts
    have no words and fail; very long texts are read whole; an empty table gives an empty one; other columns are not read.
    """
    stats = stored(document_statistics(docs), "quality")
    return apply_rules(stats, fit(stats, sampled_labels(labels, sample)))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that neither the base rules nor the trees reject: those that judge() keeps.

    Texts pass through once, with no shuffle; the trees are fitted on a sample of labels that is small enough to broadcast.
    """
    chosen = sampled_labels(labels, sample)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    trees = fit(document_statistics(slim), chosen)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, buf, off in tb.blocks(batch.column("text")):
            stat = statistics(buf, off)
            good = (stat["n_words"] >= 50) & (100 * stat["n_repeat_words"] <= 50 * stat["n_words"])
            good &= trees.score(np.stack([stat[n] for n in FEATURES], 1)) >= least
            yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return map_batches(docs, one, docs.schema)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
