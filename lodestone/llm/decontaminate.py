"""Benchmark decontamination: MinHash containment search partitioned by size, verified by exact shingle containment.

A short item inside a long document has too small a Jaccard similarity for a plain MinHash comparison of the two, so items are
partitioned by their number of shingles and each has a bottom-k MinHash sketch: its k least hash values. k is what containment asks for:
a document with at least LEAST of an item's q shingles lacks q - needed(q) of them at most, so it has one of any q - needed(q) + 1,
wherever they stand. All sketches of a size class lie under a bound, about k / q of the range of hashes; of a document only
the values under it, its own sketch for that class, are looked up. Documents that share a sketch value with an item are verified
against the item's whole set. So nothing is missed, however short the item or scattered its shingles, up to the chance that two 64-bit
hashes agree. Documents are read once for each block of items and never shuffled.
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
from lodestone.llm.arrow import map_batches, table

#: Words of a shingle, least share of an item's distinct shingles in a document.
WORDS, LEAST = 5, 0.8
#: Characters of benchmark text that are sent to the executors at a time; a larger benchmark is searched in several blocks.
ITEM_BLOCK = 16_000_000
FOUND = "doc_id long, item_id long, containment double, n_shared long, n_item_shingles long"


def shingles(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, hashes of `words` consecutive words, offsets); words: runs of letters and digits, lower-cased."""
    for lo, hi, buf, off in tb.blocks(pc.utf8_lower(column.cast(pa.string()))):
        starts, ends, rows = tb.runs(tb.ALNUM[buf], off)
        yield lo, hi, *tb.ngrams(tb.hashes(tb.prefix(buf), starts, ends), rows, words)


@dataclass
class SizeClass:
    """The items of one shingle width and size class: their sketches' values in order, whose they are, and the largest one."""

    words: int
    most: int
    values: np.ndarray
    owners: np.ndarray
    bound: np.uint64
    sieve: np.ndarray


def _pairs(values: np.ndarray, owners: np.ndarray, wanted: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(row, owner) for each sorted value that is equal to a wanted one, without repeats."""
    lo, hi = np.searchsorted(values, wanted, "left"), np.searchsorted(values, wanted, "right")
    per = hi - lo
    at = np.repeat(lo, per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    return np.unique(np.stack((np.repeat(row, per), owners[at]), 1), axis=0)


def needed(size: int, least: float) -> int:
    """The fewest of `size` shingles, one at least, that are `least` of them, by the comparison that verifies them."""
    n = min(size, max(1, int(least * size)))
    while n < size and n < least * size:
        n += 1
    return n


class Benchmark:
    """A block of items with their shingles and bottom-k sketches by size class. Items without a word are left out."""

    def __init__(self, ids: list[int], texts: list[str | None], least: float = LEAST, words: int = WORDS):
        self.ids, self.sets, width = [], [], []
        column = pa.array([t or "" for t in texts], pa.string())
        found: dict[int, tuple[int, np.ndarray]] = {}
        for w in range(1, words + 1):  # an item of fewer words is one shingle of all its words
            for lo, _, h, off in shingles(column, w):
                for k in np.flatnonzero(np.diff(off)).tolist():
                    found[lo + k] = (w, np.unique(h[off[k] : off[k + 1]]))
        for k, (w, h) in sorted(found.items()):
            self.ids.append(ids[k])
            self.sets.append(h)
            width.append(w)
        # Size classes: up to 1, 2, 4, 8, … shingles.
        step = np.array([(len(h) - 1).bit_length() for h in self.sets], np.int64)
        width = np.array(width, np.int64)
        self.classes: list[SizeClass] = []
        for w, c in sorted(set(zip(width.tolist(), step.tolist(), strict=True))):
            items = np.flatnonzero((width == w) & (step == c)).tolist()
            sketches = [self.sketch(i, least) for i in items]
            value, owners = np.concatenate(sketches), np.repeat(items, [len(x) for x in sketches])
            order = np.argsort(value, kind="stable")
            sieve = np.zeros(1 << 20, bool)
            sieve[(value & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.classes.append(SizeClass(w, 1 << c, value[order], owners[order], value.max(), sieve))

    def sketch(self, item: int, least: float) -> np.ndarray:
        """The least hash values of the item's shingles: so many that a match cannot lack all of them."""
        q = len(self.sets[item])
        return self.sets[item][: q - needed(q, least) + 1]

    def candidates(self, h: np.ndarray, off: np.ndarray, width: int) -> np.ndarray:
        """Distinct pairs (row, item) in which the row has a value of the item's sketch."""
        found = [np.zeros((0, 2), np.int64)]
        low = (h & np.uint64(0xFFFFF)).astype(np.int64)
        for c in self.classes:
            if c.words == width:
                at = np.flatnonzero((h <= c.bound) & c.sieve[low])
                found.append(_pairs(c.values, c.owners, h[at], np.searchsorted(off, at, "right") - 1))
        return np.concatenate(found)

    def widths(self) -> list[int]:
        return sorted({c.words for c in self.classes})

    def search(self, doc_ids: pa.Array, column: pa.Array, least: float) -> Iterator[pa.RecordBatch]:
        for width in self.widths():
            for lo, hi, h, off in shingles(column, width):
                pairs = self.candidates(h, off, width)
                rows, items, shared = [], [], []
                for r, i in pairs.tolist():
                    n = int(np.isin(self.sets[i], h[off[r] : off[r + 1]]).sum())
                    if n >= least * len(self.sets[i]):
                        rows.append(lo + r)
                        items.append(i)
                        shared.append(n)
                if rows:
                    size = np.array([len(self.sets[i]) for i in items], np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [doc_ids.take(pa.array(rows)), pa.array([self.ids[i] for i in items], pa.int64()), pa.array(np.array(shared) / size), pa.array(shared, pa.int64()), pa.array(size)],
                        ["doc_id", "item_id", "containment", "n_shared", "n_item_shingles"],
                    )


def _item_blocks(benchmark: DataFrame, block: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of about `block` characters: a stated query set, one block in the driver at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-total // block))
    for k in range(parts):
        part = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        rows = part.orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, words: int = WORDS, block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, containment, n_shared, n_item_shingles): each row of docs with each item of which it holds at least `least`.

    containment is exact: the share of the item's distinct shingles of `words` words (all its words, if fewer) that the whole
    document has. Null and empty texts and items without a word match nothing, very long ones are searched whole; repeated documents or items repeat
    their pairs; an empty table on either side gives an empty one. No pair is missed, save for `least` of 0 or less, where documents that share nothing are left out.
    """
    out = None
    for ids, texts in _item_blocks(benchmark, block):
        mark = Benchmark(ids, texts, least, words)

        def one(batch: pa.RecordBatch, mark: Benchmark = mark) -> Iterator[pa.RecordBatch]:
            yield from mark.search(batch.column(0), batch.column(1), least)

        part = map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, FOUND)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, words: int = WORDS, block: int = ITEM_BLOCK) -> DataFrame:
    """The rows of docs, all columns, that hold no item of the benchmark. Texts pass through, with no shuffle.

    Null and empty texts stay; repeated rows stay or go alike; without items all rows stay.
    """
    for ids, texts in _item_blocks(benchmark, block):
        mark = Benchmark(ids, texts, least, words)

        def one(batch: pa.RecordBatch, mark: Benchmark = mark) -> Iterator[pa.RecordBatch]:
            rows = pa.array(np.arange(batch.num_rows))
            bad = np.zeros(batch.num_rows, bool)
            for found in mark.search(rows, batch.column("text"), least):
                bad[found.column("doc_id").to_numpy()] = True
            yield batch.filter(pa.array(~bad))

        docs = map_batches(docs, one, docs.schema)
    return docs


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
