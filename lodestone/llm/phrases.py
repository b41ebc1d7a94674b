"""Phrases of a corpus by Apriori passes, level by level, and the cut that tells least for each.

Words are counted by language; a level then counts phrases of k words only where both phrases of k - 1 words inside are frequent, first
by a 64-bit hash alone, which is short to shuffle, and then, where that count reaches the threshold, by the phrase itself. What is
frequent goes to the executors as a table of bits by hash, whose size is bounded whatever the corpus holds: a phrase that is frequent always
has its bit, one that is not may share it, and then costs a count that the exact threshold drops. Scores come from the level tables by joins of cut
phrases with the counts of their parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm import textbytes as tb
from lodestone.llm.arrow import map_batches, table, written

#: Words of the longest phrases, least occurrences, share of a longer phrase in percent that drops one inside, rows of a language.
LONGEST, LEAST, INSIDE, TOP = 3, 10, 50, 2_000
#: Bits of the broadcast table: BITS_EACH a frequent phrase, rounded up to a power of two, MOST_BITS (32 MB) at most.
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 1 << 12, 1 << 28
#: Bytes of text that are counted together.
BLOCK = 2 << 20
#: First ranks are taken in so many parts of a language.
PARTS = 64
NO_LANG = "und"
# Characters that end a piece, that part words, and letters that are lower-cased.
_END, _LOWER = np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_END[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER[0x41:0x5B] += 0x20
_WORD = ~_END
_WORD[[0x20, 0x09]] = False
_BASE = np.uint64(0x9E3779B97F4A7C15)
COUNTS = "lang string, phrase string, key long, f long"


def _hashes(texts: pa.Array) -> np.ndarray:
    """A hash of each text, equal in every task and on the driver."""
    out = np.zeros(len(texts), np.uint64)
    for lo, hi, buf, off in tb.blocks(texts.cast(pa.string())):
        out[lo:hi] = tb.hashes(tb.prefix(buf), off[:-1], off[1:])
    return out


def frequent_bits(keys: DataFrame, bits_each: int = BITS_EACH) -> np.ndarray:
    """A table of bits with that of each row's key set; its length follows the rows up to MOST_BITS."""
    rows = keys.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, rows * bits_each - 1).bit_length()))
    low = F.col("key").bitwiseAND(F.lit(size - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))
    got = keys.groupBy(F.shiftright(low, 6).alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()  # size / 64 rows at most
    out = np.zeros(size // 64, np.uint64)
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    h = keys & np.uint64(len(bits) * 64 - 1)
    return (bits[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) > 0


def _words(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct words, each word's number among them, its row, whether the next word follows in the same piece)."""
    low = _LOWER[buf]
    starts, ends, rows = tb.runs(_WORD[low], off)
    row = np.repeat(np.arange(len(off) - 1), np.diff(rows))
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), row, np.zeros(0, bool)
    borders = np.empty(2 * len(starts) + 1, np.int64)
    borders[0:-1:2], borders[1::2], borders[-1] = starts, ends, ends[-1]
    # Words and what lies between them alternate, so the block's own bytes are the array's.
    both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(borders), pa.py_buffer(low)])
    coded = both.take(pa.array(np.arange(0, 2 * len(starts), 2))).dictionary_encode()
    stops = np.concatenate(([0], np.cumsum(_END[low])))
    joined = np.zeros(len(starts), bool)
    joined[:-1] = (row[1:] == row[:-1]) & (stops[starts[1:]] == stops[ends[:-1]])
    return coded.dictionary.cast(pa.large_string()).cast(pa.string()), coded.indices.to_numpy().astype(np.int64), row, joined


@dataclass
class Block:
    """Words of a block of texts: the distinct ones, each word's number among them, its language and that one's names, whether the next word follows in its piece."""

    words: pa.Array
    at: np.ndarray
    langs: pa.Array
    lang: np.ndarray
    joined: np.ndarray

    def starts(self, k: int) -> np.ndarray:
        """Where k words in a row begin that stay in one piece."""
        ok = np.ones(len(self.at), bool)
        for j in range(k - 1):
            ok &= np.concatenate((self.joined[j:], np.zeros(j, bool)))
        return np.flatnonzero(ok)

    def keys(self, k: int, starts: np.ndarray) -> np.ndarray:
        """A hash of language and words of each phrase of k words, equal in every task."""
        word = _hashes(self.words)[self.at]
        out = _hashes(self.langs)[self.lang[starts]]
        for j in range(k):
            out = tb.mix(out * _BASE + word[starts + j])
        return out

    def candidates(self, k: int, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, keys) of phrases of k words of which both phrases of k - 1 words inside have their bit."""
        less = self.starts(k - 1)
        good = np.zeros(len(self.at) + 1, bool)
        good[less] = _has(inner, self.keys(k - 1, less))
        starts = np.flatnonzero(good[:-1] & good[1:] & self.joined)
        return starts, self.keys(k, starts)

    def counted(self, k: int, starts: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, key, f) of the phrases that begin at starts, by the phrase itself."""
        code = self.lang[starts].astype(np.int64)
        for j in range(k):
            # Numbered anew before each product, so it stays within 63 bits.
            code = np.unique(code, return_inverse=True)[1] * max(1, len(self.words)) + self.at[starts + j]
        _, first, count = np.unique(code, return_index=True, return_counts=True)
        words = [self.words.take(pa.array(self.at[starts + j][first])) for j in range(k)]
        phrase = words[0] if k == 1 else pc.binary_join_element_wise(*words, " ")
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.lang[starts][first])), phrase, pa.array(keys[first].view(np.int64)), pa.array(count.astype(np.int64))], ["lang", "phrase", "key", "f"])


def _blocks(batch: pa.RecordBatch) -> Iterator[Block]:
    coded = batch.column(0).fill_null(NO_LANG).dictionary_encode()
    numbers = coded.indices.to_numpy()
    for lo, hi, buf, off in tb.blocks(batch.column(1), BLOCK):
        words, at, row, joined = _words(buf, off)
        if len(at):
            yield Block(words, at, coded.dictionary, numbers[lo:hi][row], joined)


def _scan(docs: DataFrame, fn, schema: str) -> DataFrame:
    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batch):
            out = fn(block)
            if out.num_rows:
                yield out

    return map_batches(docs.select(F.col("lang").cast("string").alias("lang"), "text"), one, schema)


def level_counts(docs: DataFrame, k: int, inner: np.ndarray | None = None, least: int = LEAST) -> DataFrame:
    """(lang, phrase, key, f): how often each phrase of k words stands in texts of a language; for k over 1 only frequent ones.

    inner: the bits of the frequent phrases of k - 1 words. docs: lang, text.
    """
    if k == 1:
        counted = _scan(docs, lambda b: b.counted(1, b.starts(1), b.keys(1, b.starts(1))), COUNTS)
        return counted.groupBy("lang", "phrase").agg(F.first("key").alias("key"), F.sum("f").alias("f"))
    sc = docs.sparkSession.sparkContext
    less = sc.broadcast(inner)  # MOST_BITS at most, as is the next one

    def hashed(b: Block) -> pa.RecordBatch:
        key, f = np.unique(b.candidates(k, less.value)[1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(f.astype(np.int64))], ["key", "f"])

    sums = _scan(docs, hashed, "key long, f long").groupBy("key").agg(F.sum("f").alias("f")).where(F.col("f") >= least)
    own = sc.broadcast(frequent_bits(written(sums.select("key"))))

    def exact(b: Block) -> pa.RecordBatch:
        starts, keys = b.candidates(k, less.value)
        some = _has(own.value, keys)
        return b.counted(k, starts[some], keys[some])

    counted = _scan(docs, exact, COUNTS).groupBy("lang", "phrase").agg(F.first("key").alias("key"), F.sum("f").alias("f"))
    return counted.where(F.col("f") >= least)


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and a written table (lang, phrase, f) of the frequent phrases of each length from 1 word to the longest.

    A pass that finds no frequent phrase ends the search; the tables after it are empty.
    """
    words = written(level_counts(docs, 1))
    found = [words.where(F.col("f") >= least)]
    for k in range(2, longest + 1):
        found.append(written(level_counts(docs, k, frequent_bits(found[-1]), least)))
    return words.groupBy("lang").agg(F.sum("f").alias("n")), [level.drop("key") for level in found]


def phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first phrases.

    A null lang is `und`; null and empty texts hold no words; repeated rows count as often as they occur; an empty table gives no rows.
    Ties of the score go by a, then by the phrase's bytes. Counts may reach 10 ** 15: products are taken in 38 decimal digits.
    """
    totals, found = levels(docs, longest, least)
    exact = "decimal(16,0)"
    scored = None
    for k, level in enumerate(found[1:], 2):
        words, best = F.split("phrase", " "), level.withColumnRenamed("f", "a")
        for cut in range(1, k):
            left, right = found[cut - 1], found[k - cut - 1]
            best = best.withColumn("first", F.array_join(F.slice(words, 1, cut), " ")).withColumn("rest", F.array_join(F.slice(words, cut + 1, k - cut), " "))
            best = best.join(left.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l_")), ["lang", "first"]).drop("first")
            best = best.join(right.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r_")), ["lang", "rest"]).drop("rest")
            a, product = F.col("a").cast(exact), F.col("l_").cast(exact) * F.col("r_").cast(exact)
            best = best.withColumn("s_", F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * a * a, product))
            new = F.struct(F.col("s_").alias("score"), F.lit(cut).alias("cut"), F.col("l_").alias("l"), F.col("r_").alias("r"))
            best = best.withColumn("cut", F.least("cut", new) if cut > 1 else new).drop("l_", "r_", "s_")
        scored = best if scored is None else scored.unionByName(best)
    covered = None
    for k, level in enumerate(found[1:], 2):
        words = F.split("phrase", " ")
        for size in range(2, k):
            for at in range(k - size + 1):
                part = level.select("lang", F.array_join(F.slice(words, at + 1, size), " ").alias("phrase"), F.col("f").alias("longer"))
                covered = part if covered is None else covered.unionByName(part)
    if covered is not None:
        covered = covered.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        scored = scored.join(covered, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    flat = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    near = flat.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    return phrases(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH pieces AS (
  SELECT lang, doc_id, piece, p FROM (
    SELECT coalesce(lang, '{NO_LANG}') AS lang, doc_id, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]'), 1) AS piece
    FROM (SELECT *, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS doc_id FROM (SELECT lang, text FROM documents)))
), words AS (
  SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM pieces)
), f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(ws) GROUP BY ALL
), n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY ALL),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1 AND f >= {LEAST}),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, cut, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:cut], ' ') AND l.k = cut
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ') AND r.k = c.k - cut
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
held AS (
  SELECT lang, phrase, max(longer) AS longer FROM (
    SELECT lang, array_to_string(ws[1:2], ' ') AS phrase, a AS longer FROM cand WHERE k = 3 UNION ALL SELECT lang, array_to_string(ws[2:3], ' '), a FROM cand WHERE k = 3) GROUP BY ALL
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase JOIN n ON n.lang = b.lang
WHERE longer IS NULL OR 100 * longer < {INSIDE} * a QUALIFY rank <= {TOP}
"""
