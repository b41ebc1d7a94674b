"""SimHash near-duplicates: fingerprints of whole texts, links found with a Gray-order hierarchical index.

Two fingerprints of at most `bits` differing bits agree on at least `keep` of `keep + bits` blocks of bits, so
each distinct fingerprint is dealt under every choice of `keep` blocks, and linked ones meet under one of
them. Each group that meets is searched with an index: fingerprints sorted by Gray rank, runs of neighbours joined to nodes that
hold the bits all of them share, and pairs of nodes dropped as soon as their shared bits differ in too many places. Pairs
of nodes that must be linked throughout, or that are connected already, are not opened either, so a group of very many near copies
yields a star of links, not all its pairs. Components of the links are found without collecting them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import map_batches, stored, table
from lodestone.llm.components import connected

#: Words of a shingle and most differing bits of a link.
WORDS, BITS = 4, 4
#: Blocks of a fingerprint that must agree; 2 of 6 for 4 bits gives 15 tables with keys of about 21 bits.
KEEP = 2
#: Ids of dropped documents that are sent to all executors at most (8 bytes each and their table).
BROADCAST_IDS = 2_000_000
#: Rows of a group that one task searches at most, and rows of whole groups that it searches at a time.
GROUP, FLUSH = 1_000_000, 200_000
SEED = 42
_FAN = 8
_CHUNK = 1 << 20


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bit k is set if it is in over half of the shingles' XXH64; 0 without words."""
    from xxhash import xxh64_intdigest

    norm = b" ".join(text.lower().split())
    if not norm:
        return 0
    blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    n = max(len(blanks) + 2 - words, 1)
    starts = [0, *(blanks[: n - 1] + 1).tolist()]
    ends = [*blanks[words - 1 :].tolist(), len(norm)]
    total = np.zeros(64, np.int64)
    for lo in range(0, n, 65536):
        h = np.array([xxh64_intdigest(norm[a:b], SEED) for a, b in zip(starts[lo : lo + 65536], ends[lo : lo + 65536], strict=True)], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (a signed long) of each row."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        fps = np.fromiter((fingerprint((t or "").encode(), words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each value in the reflected Gray code."""
    x = x.copy()
    for k in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(k)
    return x


def blocks(keep: int = KEEP, bits: int = BITS) -> list[int]:
    """The mask of each choice of `keep` of `keep + bits` blocks of a 64-bit fingerprint."""
    edge = [64 * k // (keep + bits) for k in range(keep + bits + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edge, edge[1:], strict=False)]
    return [sum(part[k] for k in choice) for choice in combinations(range(keep + bits), keep)]


class _Sets:
    def __init__(self, n: int):
        self.to = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> bool:
        changed = False
        while len(a):
            a, b = self.to[a], self.to[b]
            a, b = np.minimum(a, b), np.maximum(a, b)
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.to, b, a)
                while not np.array_equal(up := self.to[self.to], self.to):
                    self.to = up
                changed = True
        return changed


class GrayIndex:
    """Levels of nodes over fingerprints that are sorted by group and Gray rank; a node covers up to 8 below it in one group."""

    def __init__(self, fp: np.ndarray, off: np.ndarray):
        self.levels = [(fp, np.full(len(fp), np.uint64(0xFFFFFFFFFFFFFFFF)), np.arange(len(fp)), np.ones(len(fp), np.int64))]
        self.children: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        low, high = fp, fp
        while (count := np.diff(off)).max(initial=0) > 1 or len(self.levels) == 1:
            ups = (count + _FAN - 1) // _FAN
            new = np.concatenate(([0], np.cumsum(ups)))
            start = np.repeat(off[:-1], ups) + _FAN * (np.arange(new[-1]) - np.repeat(new[:-1], ups))
            size = np.minimum(_FAN, np.repeat(off[1:], ups) - start)
            low, high = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)
            first = self.levels[-1][2][start]
            self.levels.append((low, ~(low ^ high), first, np.add.reduceat(self.levels[-1][3], start)))
            self.children.append((start, size))
            off = new
        self.top = len(self.levels) - 1

    def components(self, bits: int) -> np.ndarray:
        """For each fingerprint the place of the first one that it is connected with by links inside its group."""
        sets = _Sets(len(self.levels[0][0]))
        roots = np.flatnonzero(self.levels[self.top][3] > 1)
        work = [(self.top, roots, roots)]
        fresh = False
        while work:
            level, u, v = work.pop()
            if fresh and level:
                u, v = self._unlike(sets, level, u, v)
            if not len(u):
                continue
            start, size = self.children[level]
            many = np.cumsum(size[u] * size[v])
            if many[-1] > _CHUNK and len(u) > 1:
                cut = max(1, int(np.searchsorted(many, _CHUNK)))
                work.append((level, u[cut:], v[cut:]))
                u, v = u[:cut], v[:cut]
            per = size[u] * size[v]
            at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
            wide = np.repeat(size[v], per)
            a, b = np.repeat(start[u], per) + at // wide, np.repeat(start[v], per) + at % wide
            level -= 1
            keep = a < b if not level else (a <= b)
            keep |= np.repeat(u != v, per)
            a, b = a[keep], b[keep]
            shared, mask, first, covers = self.levels[level]
            both = mask[a] & mask[b]
            least = np.bitwise_count((shared[a] ^ shared[b]) & both)
            near = least <= bits
            a, b = a[near], b[near]
            sure = least[near] + np.bitwise_count(~both[near]) <= bits
            if sure.any():
                fresh |= sets.join(*self._star(a[sure], b[sure], first, covers))
            if level:
                work.append((level, a[~sure], b[~sure]))
        return sets.to

    @staticmethod
    def _star(a: np.ndarray, b: np.ndarray, first: np.ndarray, covers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes = np.unique(np.concatenate((a, b)))
        n = covers[nodes]
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hub = np.repeat(first[nodes], n)
        return np.concatenate((first[a], hub)), np.concatenate((first[b], hub + inside))

    def _unlike(self, sets: _Sets, level: int, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs that are not wholly in one set already."""
        _, _, first, _ = self.levels[level]
        low, high = np.minimum.reduceat(sets.to, first), np.maximum.reduceat(sets.to, first)
        open_ = (low[u] != high[u]) | (low[v] != high[v]) | (low[u] != low[v])
        return u[open_], v[open_]


def links(fps: DataFrame, bits: int = BITS, keep: int = KEEP, most: int = GROUP) -> DataFrame:
    """(u, v): nodes whose links connect all fingerprints of at most `bits` differing bits. fps: distinct, columns fp and node.

    Fingerprints are dealt under every choice of blocks. A group of over `most` rows is not searched by the task that meets it: its
    rows are salted into m parts, each pair of parts is a group of its own, and a row goes to the m pairs of its part. So the memory of a task
    is about `most` rows, a hot group is spread over m (m + 1) / 2 tasks, and no link is lost.
    """
    kind = fps.schema["node"].dataType.simpleString()
    masks = F.explode(F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for k, m in enumerate(blocks(keep, bits)))))
    dealt = fps.select("fp", "node", masks.alias("at")).select("at.t", "at.key", "fp", "node")
    found = stored(_searched(dealt, kind, bits, most), "links")
    out = found.where("u is not null").select("u", "v")
    large = found.where("u is null").select("t", "key").distinct()
    n = large.count()
    if not n:
        return out
    hot = dealt.join(F.broadcast(large) if n <= BROADCAST_IDS else large, ["t", "key"], "left_semi")
    parts = stored(hot.groupBy("t", "key").agg(F.ceil(2.5 * F.count(F.lit(1)) / most).cast("long").alias("m")), "parts")
    salted = hot.join(F.broadcast(parts) if n <= BROADCAST_IDS else parts, ["t", "key"]).withColumn("salt", F.pmod(F.xxhash64("fp", F.lit(SEED)), "m"))
    paired = salted.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1)))
    # Two pairs with one hash are searched together, which does no harm.
    pair = F.xxhash64("t", "key", F.least("salt", "other"), F.greatest("salt", "other")).alias("key")
    return out.unionByName(_searched(paired.select(F.lit(-1).alias("t"), pair, "fp", "node"), kind, bits, 1 << 62).select("u", "v"))


def _searched(dealt: DataFrame, kind: str, bits: int, most: int) -> DataFrame:
    """(t, key, u, v): links inside each group; a group of over `most` rows gives a row of null u and v instead."""
    sorted_ = dealt.repartition("t", "key").sortWithinPartitions("t", "key").select("t", "key", "fp", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole: list[pa.RecordBatch] = []  # groups that have ended
        open_: list[pa.RecordBatch] = []  # the last group so far; its first row alone once it is too large
        last, too_large = None, False

        def rows(held: list[pa.RecordBatch]) -> int:
            return sum(b.num_rows for b in held)

        for batch in batches:
            t, key = (batch.column(c).to_numpy() for c in (0, 1))
            edge = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            first, final = (int(edge[0]), int(edge[-1])) if len(edge) else (batch.num_rows, 0)
            if (t[0], key[0]) != last:
                whole, open_, too_large, last = whole + ([] if too_large else open_), [], False, (t[0], key[0])
            if not too_large:
                open_.append(batch.slice(0, first))
                if rows(open_) > most:
                    too_large, open_ = True, []
                    yield _marks(t[:1], key[:1], batch.column(3).type)
            if len(edge):
                whole += [*([] if too_large else open_), batch.slice(first, final - first)]
                open_, too_large, last = [batch.slice(final)], False, (t[-1], key[-1])
            if rows(whole) >= FLUSH:
                yield from _linked(whole, bits, most)
                whole = []
        yield from _linked(whole + ([] if too_large else open_), bits, most)

    return sorted_.mapInArrow(run, f"t int, key long, u {kind}, v {kind}")


def _marks(t: np.ndarray, key: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    none = pa.nulls(len(t), kind)
    return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(key, pa.int64()), none, none], ["t", "key", "u", "v"])


def _linked(held: list[pa.RecordBatch], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    if not sum(b.num_rows for b in held):
        return
    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
    t, key, fp = (rows.column(c).to_numpy() for c in (0, 1, 2))
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(t)))
    large = size > most
    if large.any():
        yield _marks(t[start[large]], key[start[large]], rows.column(3).type)
    group = np.cumsum(new) - 1
    some = np.flatnonzero(((size > 1) & ~large)[group])
    if not len(some):
        return
    group, fp = group[some], fp[some].view(np.uint64)
    order = np.lexsort((gray_rank(fp), group))
    group, fp, at = group[order], fp[order], some[order]
    off = np.concatenate((np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), [len(group)]))
    to = GrayIndex(fp, off).components(bits)
    moved = np.flatnonzero(to != np.arange(len(to)))
    if len(moved):
        u, v = at[moved], at[to[moved]]
        node = rows.column(3)
        yield pa.RecordBatch.from_arrays([pa.array(t[u], pa.int32()), pa.array(key[u], pa.int64()), node.take(pa.array(u)), node.take(pa.array(v))], ["t", "key", "u", "v"])


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS, keep: int = KEEP, most: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the least doc_id that links reach) of each row.

    Null, empty and blank texts have fingerprint zero and are linked like all others; very long texts are read whole. A null doc_id never
    names a component that has another. Repeated rows and ties stay; an empty table gives an empty one; other columns are not read.
    Memory of a task: FLUSH rows and `most` more. A fingerprint's node is the least doc_id that has it, so components carry their
    name from the start and no rows meet by component.
    """
    marked = stored(fingerprints(docs, words), "fingerprints")
    wide = "decimal(20,0)"
    # Fingerprints of rows without an id alone come after all ids.
    node = F.coalesce(F.col("least").cast(wide), (F.col("fp").cast(wide) + F.lit(str(2**64)).cast(wide)).cast(wide))
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", node.alias("node")), "distinct")
    root = connected(links(distinct, bits, keep, most)).withColumnsRenamed({"u": "node", "v": "root"})
    least = F.coalesce("root", "node")
    named = distinct.join(root, "node", "left").select("fp", F.when(least < F.lit(str(2**63)).cast(wide), least.cast("long")).alias("component_id"))
    return marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, bits: int = BITS, keep: int = KEEP) -> DataFrame:
    """The rows of docs, all columns, of which one document of each component stays: that of the least doc_id.

    Rows that repeat a doc_id and text count as one; rows without a doc_id can't stand for others and stay. Only ids are
    joined: those that go are broadcast up to BROADCAST_IDS, beyond that texts are shuffled once. Columns may have any names.
    """
    placed = stored(near_duplicates(docs, words, bits, keep).where("doc_id is not null"), "placed")
    # A doc_id with several texts goes where any of them stands for its component.
    gone = placed.groupBy("doc_id").agg(F.count_if(F.col("doc_id") == F.col("component_id")).alias("own"), F.count(F.lit(1)).alias("rows")).where("own = 0 or rows > 1")
    gone = stored(gone, "gone")
    few = gone.count() <= BROADCAST_IDS
    name = "_" * (1 + max(map(len, docs.columns)))  # no column of docs

    def of(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("doc_id").alias(name))
        return F.broadcast(rows) if few else rows

    same = F.col("doc_id").cast("long") == F.col(name)
    stay = docs.join(of(gone), same, "left_anti")
    repeated = gone.where("own > 0")
    if repeated.isEmpty():
        return stay
    return stay.unionByName(docs.join(of(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
