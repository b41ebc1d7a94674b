"""Toxicity from class-conditional Kneser-Ney models over the letters of words.

Toxic and ordinary text each have a Kneser-Ney model of five bytes of letters whose two shortest orders are shared: what neither class
has seen often gets the same probability from both and says nothing. A text's mean log-likelihood ratio per letter, those of
its most telling words and the share of words that tell go through a logistic curve, so the verdict is that of both models' likelihoods, by
letter and by word. The curve is fitted on a fold of the labelled rows, with a model of the others. The
final model counts all labelled rows that are not held out. They are summed by gram in Spark, and so are the totals of contexts and the counts of shorter
grams, over all grams. A model of up to MODEL_GRAMS grams of a class and order is sent to the executors as sorted arrays. One of more stays in Spark
as tables: joins give the ratio of every gram of the texts, the executors get those that the texts hold most, and each text its others by a join. No gram is left out of either.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.arrow import held_out, map_batches, table, written
from lodestone.llm.bpe import LETTER, classes
from lodestone.llm.quality import bounded_sample

#: Bytes of the longest grams, of the longest shared ones, the discount, and the labelled rows that the curve is fitted on, at
#: most about so many.
ORDER, SHARED, DISCOUNT, SAMPLE = 5, 2, 0.75, 20_000
#: Grams of a class and order that a task holds, at most: a model of more is looked up by joins.
MODEL_GRAMS = 2_000_000
#: Ratios that a task holds then, of the grams that the texts hold most; each text gets those of its others by a join.
KNOWN_GRAMS = 4_000_000
#: A word tells if toxic text makes it e to this power more likely than ordinary text.
TELLING = (1.0, 2.0, 3.0)
#: Labels that are sent to all executors at most; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
#: Bits of a unit: letters are spelled in UTF-8, so each has its own spelling and a gram of ORDER bytes is one number.
WIDE = 8


def streams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes of letters, offsets): lower-cased letters, one blank for all between, and as many before each row as a gram looks back."""
    lower = pc.utf8_lower(column.cast(pa.string()))
    for lo, hi, buf, off in tb.blocks(lower):
        points = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        letter = classes()[points] == LETTER
        code = np.where(letter[np.cumsum((buf & 0xC0) != 0x80) - 1], buf, 32) if len(buf) else buf
        keep = np.ones(len(code), bool)
        keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
        first = off[:-1][off[:-1] < off[1:]]
        keep[first] = code[first] != 32
        kept = np.concatenate(([0], np.cumsum(keep)))[off]
        code = np.insert(code[keep], np.repeat(kept[:-1], ORDER - 1), 32)
        yield lo, hi, code, kept + (ORDER - 1) * np.arange(len(kept))


def keys(code: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gram that ends at each letter of a text as a number, and their offsets."""
    wide = code.astype(np.int64)
    key = np.zeros(max(len(code) - ORDER + 1, 0), np.int64)
    for k in range(ORDER):
        key = key << WIDE | wide[k : len(code) - ORDER + 1 + k]
    own = np.maximum(np.diff(off) - (ORDER - 1), 0)
    new = np.concatenate(([0], np.cumsum(own)))
    return key[np.arange(new[-1]) + np.repeat(off[:-1] - new[:-1], own)], new


def gram_counts(labelled: DataFrame) -> DataFrame:
    """(toxic, gram, n) of all rows; labelled: text, toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
            gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return gram, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for c, parts in held.items():
                if parts:
                    gram, n = summed(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), c, np.int32)), pa.array(gram), pa.array(n)], ["toxic", "gram", "n"])

        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, code, off in streams(batch.column(0)):
                key, edge = keys(code, off)
                mine = np.repeat(toxic[lo:hi], np.diff(edge))
                for c in held:
                    gram, n = np.unique(key[mine == c], return_counts=True)
                    if len(gram):
                        held[c].append((gram, n))
                        if len(held[c]) >= 32:
                            held[c] = [summed(held[c])]
            if sum(len(p[0]) for parts in held.values() for p in parts) > 4_000_000:
                yield from out()
                held = {0: [], 1: []}
        yield from out()

    return labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(run, "toxic int, gram long, n long").groupBy("toxic", "gram").agg(F.sum("n").alias("n"))


def _found(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, other: float) -> np.ndarray:
    """The value of each wanted key in a table of sorted keys; `other` for keys that are not in it."""
    keys, values = table
    if not len(keys):
        return np.full(len(wanted), other, np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], np.float32(other))


@dataclass
class Model:
    """shared: probability of a letter after the one before it. kept, back: for each class and longer order, the discounted
    share of each gram and what each context hands to the shorter order, as (sorted keys, values) of all that were seen."""

    shared: np.ndarray
    kept: list[list[tuple[np.ndarray, np.ndarray]]]
    back: list[list[tuple[np.ndarray, np.ndarray]]]

    def likelihoods(self, gram: np.ndarray, k: int = ORDER) -> np.ndarray:
        """P(last letter | those before it) by class and gram; gram: sorted grams of k letters."""
        if k == SHARED:
            return np.stack((self.shared[gram],) * 2)
        shorter, at = np.unique(gram & ((1 << WIDE * (k - 1)) - 1), return_inverse=True)
        p = self.likelihoods(shorter, k - 1)[:, at]
        for c in (0, 1):
            j = k - SHARED - 1
            p[c] = _found(self.kept[c][j], gram, 0) + _found(self.back[c][j], gram >> WIDE, 1) * p[c]
        return p

    def ratios(self, key: np.ndarray) -> np.ndarray:
        """log P(letter | before, toxic) - log P(letter | before, ordinary) of each gram's last letter."""
        gram, at = np.unique(key, return_inverse=True)
        log = np.log(np.maximum(self.likelihoods(gram), 1e-12))
        return (log[1] - log[0]).astype(np.float64)[at]


@dataclass
class Tables:
    """The same model in Spark, for more grams than a task should hold; levels: (toxic, gram, n) of all grams, from the shortest order over SHARED on."""

    shared: np.ndarray
    levels: list[DataFrame]

    def ratios(self, grams: DataFrame) -> DataFrame:
        """grams, whose `gram` is distinct, with the ratio that a Model of all grams gives."""
        wanted = [grams]
        for k in range(ORDER - 1, SHARED, -1):
            wanted.insert(0, wanted[0].select(_tail(k).alias("gram")).distinct())
        pairs = pa.table({"tail": np.arange(len(self.shared)), **{f"p{c}": self.shared.astype(np.float64) for c in (0, 1)}})
        shorter = F.broadcast(grams.sparkSession.createDataFrame(pairs))
        for k, (level, some) in enumerate(zip(self.levels, wanted), SHARED + 1):
            own = [F.when(F.col("toxic") == c, F.col("n")) for c in (0, 1)]
            seen = level.groupBy("gram").agg(*(F.sum(own[c]).alias(f"n{c}") for c in (0, 1)))
            contexts = level.groupBy(F.shiftright("gram", WIDE).alias("context")).agg(*(f(own[c]).alias(f"{n}{c}") for c in (0, 1) for n, f in (("total", F.sum), ("types", F.count))))
            met = some.withColumns({"context": F.shiftright("gram", WIDE), "tail": _tail(k - 1)}).join(seen, "gram", "left").join(contexts, "context", "left").join(shorter, "tail")
            share = [F.greatest(F.coalesce(f"n{c}", F.lit(0)) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"types{c}") * F.col(f"p{c}") for c in (0, 1)]
            some = met.select(*some.columns, *(F.when(F.col(f"total{c}") > 0, share[c] / F.col(f"total{c}")).otherwise(F.col(f"p{c}")).alias(f"p{c}") for c in (0, 1)))
            shorter = some.withColumnRenamed("gram", "tail")
        log = [F.log(F.greatest(f"p{c}", F.lit(1e-12))) for c in (0, 1)]
        return some.select(*grams.columns, (log[1] - log[0]).cast("float").alias("ratio"))


@dataclass
class Known:
    """Ratios of grams: of those that all texts hold most, and of the others of a batch, as (sorted keys, values)."""

    most: tuple[np.ndarray, np.ndarray]
    others: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.float32))

    def beside(self, rest: pa.Array) -> Known:
        """With the grams of a column of lists of (gram, ratio)."""
        flat = rest.flatten()
        gram, first = np.unique(flat.field(0).to_numpy(), return_index=True)
        return Known(self.most, (gram, flat.field(1).to_numpy()[first]))

    def lacks(self, gram: np.ndarray) -> np.ndarray:
        return np.isnan(_found(self.most, gram, np.nan))

    def ratios(self, key: np.ndarray) -> np.ndarray:
        gram, at = np.unique(key, return_inverse=True)
        ratio = _found(self.most, gram, np.nan)
        ratio = np.where(np.isnan(ratio), _found(self.others, gram, np.nan), ratio)
        if np.isnan(ratio).any():
            raise ValueError("grams of a text without a ratio")
        return ratio.astype(np.float64)[at]


def _tail(k: int) -> Column:
    """The last k letters of a gram."""
    return F.col("gram").bitwiseAND(F.lit((1 << WIDE * k) - 1))


def _least(level: DataFrame, most: int) -> list[int]:
    """For each class the least number of times, of four leading bits, such that at most `most` grams are seen as often; 1: all are."""
    rounded = F.expr("n - n % shiftleft(1L, greatest(length(bin(n)) - 4, 0))")
    sizes = level.groupBy("toxic", rounded.alias("times")).agg(F.count(F.lit(1)).alias("rows")).collect()
    least = []
    for c in (0, 1):
        own = sorted(((r["times"], r["rows"]) for r in sizes if r["toxic"] == c), reverse=True)
        fit = int((np.cumsum([rows for _, rows in own]) <= most).sum())
        least.append(1 if fit == len(own) else own[fit - 1][0] if fit else 2 * own[0][0])
    return least


def _shared(level: DataFrame) -> np.ndarray:
    """Probability of a letter after the one before it, from the grams of the shortest order that is not shared."""
    pairs = level.select("gram").distinct().groupBy(_tail(2).alias("pair")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    n = np.zeros((1 << WIDE, 1 << WIDE))
    n.reshape(-1)[pairs.column("pair").to_numpy()] = pairs.column("n").to_numpy()
    alone = ((n > 0).sum(0) + 1) / ((n > 0).sum() + (1 << WIDE))
    total, types = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    two = np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * types * alone) / np.maximum(total, 1), alone)
    return two.reshape(-1).astype(np.float32)


def fit_model(counts: DataFrame, most: int | None = None) -> Model | Tables:
    """Kneser-Ney: the longest grams by their counts, shorter ones by how many different letters come before them.

    All grams that were seen, as arrays or, if a class has over MODEL_GRAMS, as tables. Callers that want a small model instead give `most`: a class and
    order that has more keeps those seen at least some number of times, and what a context's kept grams leave goes to the shorter order.
    """
    levels = [counts]
    for k in range(ORDER - 1, SHARED, -1):
        levels.insert(0, written(levels[0].groupBy("toxic", _tail(k).alias("gram")).agg(F.count(F.lit(1)).alias("n"))))
    shared = _shared(levels[0])
    # No shorter order has more grams than the longest.
    if most is None and max(_least(counts, MODEL_GRAMS)) > 1:
        return Tables(shared, levels)
    kept, back = ([[None] * (ORDER - SHARED) for _ in range(2)] for _ in range(2))
    for j, level in enumerate(levels):
        held = level.withColumn("context", F.shiftright("gram", WIDE))
        totals = held.groupBy("toxic", "context").agg(F.sum("n").alias("total"))
        if most is not None:
            least = _least(level, most)
            held = held.where(F.col("n") >= F.when(F.col("toxic") == 0, least[0]).otherwise(least[1]))
        seen = held.join(totals, ["toxic", "context"]).select("toxic", "gram", "n", "total").toArrow()
        toxic, gram, n, total = (seen.column(c).to_numpy() for c in ("toxic", "gram", "n", "total"))
        for c in (0, 1):
            own = np.flatnonzero(toxic == c)
            own = own[np.argsort(gram[own])]
            share = (n[own] - DISCOUNT) / total[own]
            context = gram[own] >> WIDE
            start = np.flatnonzero(np.diff(context, prepend=-1))
            kept[c][j] = gram[own], share.astype(np.float32)
            back[c][j] = context[start], (1 - (np.add.reduceat(share, start) if len(start) else share)).astype(np.float32)
    return Model(shared, kept, back)


FEATURES = ("mean", "log_letters", "first", "second", "third", *(f"{kind}_{t:.0f}" for t in TELLING for kind in ("telling", "share")))


def features(model: Model | Known, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """FEATURES of each text: the mean ratio per letter, the three largest of a word, and how many words are over each of TELLING
    (the logarithm of one more) and by the root of all words."""
    for lo, hi, code, off in streams(column):
        key, edge = keys(code, off)
        n = np.diff(edge)
        ratio = model.ratios(key)
        out = np.zeros((hi - lo, len(FEATURES)))
        out[:, 0] = tb.sums_by_row(ratio, edge) / np.maximum(n, 1)
        out[:, 1] = np.log1p(n)
        starts, ends, words = tb.runs(key & ((1 << WIDE) - 1) != 32, edge)
        total = np.concatenate(([0.0], np.cumsum(ratio)))
        each = total[ends] - total[starts]
        per = np.diff(words)
        row = np.repeat(np.arange(hi - lo), per)
        order = np.lexsort((-each, row))
        for k in range(3):
            some = np.flatnonzero(per > k)
            out[some, 2 + k] = each[order][words[:-1][some] + k]
        for k, t in enumerate(TELLING):
            count = np.bincount(row, each > t, hi - lo)
            out[:, 5 + 2 * k] = np.log1p(count)
            out[:, 6 + 2 * k] = count / np.sqrt(np.maximum(per, 1))
        yield lo, hi, out


@dataclass
class Curve:
    center: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.concatenate(((x - self.center) / self.scale, np.ones((len(x), 1))), 1) @ self.weight
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> Curve:
    """Logistic regression by Newton's steps, halved until the loss falls. One class only, or no rows: a constant."""
    center, scale = (x.mean(0), x.std(0) + 1e-9) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = np.concatenate(((x - center) / scale, np.ones((len(x), 1))), 1)
    w = np.zeros(z.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.01
    w[-1] = np.log(share / (1 - share))
    some = np.append(np.ones(x.shape[1]), 0.0) * ridge

    def loss(w: np.ndarray) -> float:
        return float(np.logaddexp(0, np.where(y > 0, -1, 1) * (z @ w)).sum() + (some * w * w).sum() / 2)

    now = loss(w)
    for _ in range(60 if len(set(y.tolist())) > 1 else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(some + 1e-6), z.T @ (p - y) + some * w)
        size = 1.0
        while size > 1e-6 and (after := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-6 or now - after < 1e-9:
            break
        w, now = w - size * step, after
    return Curve(center, scale, w)


def _pack(model: Model | Known) -> bytes:
    """The tables as compressed bytes."""
    return zlib.compress(pickle.dumps(model), 1)


@lru_cache(1)
def _unpack(packed: bytes) -> Model | Known:
    return pickle.loads(zlib.decompress(packed))


def _shipped(model: Model | Tables, df: DataFrame) -> tuple[Broadcast, DataFrame]:
    """What all tasks get to score df (text and more), and df; for tables with packed texts and `rest`, the ratios of a text's other grams."""
    sc = df.sparkSession.sparkContext
    if isinstance(model, Model):
        return sc.broadcast(_pack(model)), df
    wanted = written(model.ratios(written(gram_counts(df.select("text", F.lit(0).alias("toxic"))))))
    least = _least(wanted, KNOWN_GRAMS)[0]
    most = wanted.where(F.col("n") >= least).select("gram", "ratio").toArrow().sort_by("gram")
    shipped = sc.broadcast(_pack(Known((most.column("gram").to_numpy(), most.column("ratio").to_numpy()))))
    if least == 1:
        return shipped, df

    def lacking(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo, hi, code, off in streams(batch.column("text")):
            key, edge = keys(code, off)
            gram, at = np.unique(key, return_inverse=True)
            there = np.flatnonzero(_unpack(shipped.value).lacks(gram)[at])
            of, mine = np.unique(batch.column("of")[lo:hi].to_numpy(), return_inverse=True)
            pair = np.unique(np.repeat(mine, np.diff(edge))[there] * len(gram) + at[there])
            own, which = np.divmod(pair, max(len(gram), 1))
            yield pa.RecordBatch.from_arrays([pa.array(of[own]), pa.array(gram[which])], ["of", "gram"])

    # Texts go by a hash: two that share one get the grams of both.
    named = df.withColumn("of", F.xxhash64("text"))
    pairs = map_batches(named.select("of", "text"), lacking, "of long, gram long").repartition("gram").distinct()
    rest = pairs.join(wanted.where(F.col("n") < least).select("gram", "ratio"), "gram").repartition("of").groupBy("of").agg(F.collect_list(F.struct("gram", "ratio")).alias("rest"))
    return shipped, named.withColumn("text", F.arrow_udf(_packed, "binary")("text")).join(rest, "of", "left").drop("of")


def _packed(text: pa.Array) -> pa.Array:
    """Texts as compressed bytes: a shuffle of them takes less room."""
    return pa.array([zlib.compress(t.as_buffer(), 1) if t.is_valid else None for t in text], pa.binary())


def _opened(packed: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts), about a block at a time."""
    lo, size, held = 0, 0, []
    for hi, some in enumerate(packed, 1):
        held.append(zlib.decompress(some.as_py()) if some.is_valid else None)
        size += len(held[-1] or b"")
        if hi == len(packed) or size > tb.BLOCK:
            yield lo, pa.array(held, pa.binary()).cast(pa.string())
            lo, size, held = hi, 0, []


def _scored(shipped: Broadcast, df: DataFrame, passed: dict[str, str], finish) -> DataFrame:
    """mapInArrow over df (text, packed if there is a rest, and the passed columns): finish(features) gives more columns."""
    kinds = ", ".join(f"{n} {k}" for n, k in passed.items())

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, parts = _unpack(shipped.value), [(0, batch.column("text"))]
        if "rest" in batch.schema.names:
            model, parts = model.beside(batch.column("rest")), _opened(batch.column("text"))
        for at, some in parts:
            for lo, hi, x in features(model, some):
                more = finish(x)
                yield pa.RecordBatch.from_arrays([*(batch.column(n)[at + lo : at + hi] for n in passed), *map(pa.array, more.values())], [*passed, *more])

    more = finish(np.zeros((0, len(FEATURES))))
    return map_batches(df.select(*passed, "text", *(n for n in df.columns if n == "rest")), one, ", ".join([kinds, *(f"{n} {'int' if v.dtype == np.int32 else 'double'}" for n, v in more.items())]))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs.

    Null and empty texts get what the curve says of no letters; very long texts are read whole. Rows with a null label teach nothing; of several
    labels of a document the highest counts. Repeated rows are scored alike; an empty table gives an empty one; other columns are not read. Labels are joined to texts by a broadcast up to BROADCAST_ROWS, else by a shuffle.
    """
    known = labels.where(F.col("toxic").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).where(~held_out())
    known = F.broadcast(known) if labels.count() <= BROADCAST_ROWS else known
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labelled = slim.where(~held_out()).join(known, "doc_id").where("toxic in (0, 1)")
    # A fold of the labelled rows fits the curve, with a model of the others: on its own rows the model would look too sure.
    fold = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    others, own = (written(gram_counts(labelled.where(some))) for some in (~fold, fold))
    first, judged = _shipped(fit_model(others), bounded_sample(labelled.where(fold), sample))
    rows = _scored(first, judged, {"doc_id": "long", "toxic": "int"}, lambda x: {n: x[:, k] for k, n in enumerate(FEATURES)}).toPandas().sort_values(["doc_id", *FEATURES])
    curve = fit_curve(rows[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), rows["toxic"].to_numpy(float))
    first.destroy()
    # The final model counts the fold too.
    counts = written(others.unionByName(own).groupBy("toxic", "gram").agg(F.sum("n").alias("n")))
    model, all_docs = _shipped(fit_model(counts), slim.withColumn("held_out", held_out()))

    def finish(x: np.ndarray) -> dict[str, np.ndarray]:
        s = curve.score(x)
        return {"score": s, "predicted": (s >= 0.5).astype(np.int32)}

    return _scored(model, all_docs, {"doc_id": "long", "held_out": "boolean"}, finish)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
