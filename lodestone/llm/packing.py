"""Best-two-fit packing of tokenised documents into sequences of a fixed length.

Token ids come from a public tokenizer; documents longer than a sequence are cut into full pieces (the first may be
shorter), all others stay whole. Pieces (a few numbers each, never ids or texts) are dealt by a hash of the document,
AQE merges small partitions, and each partition fills its own sequences: greedily with the longest piece that fits,
then, where a gap stays, by replacing the sequence's smallest piece with the two unpacked pieces that fill the widened gap best.
A partition works on piece lengths (at most `length` different ones), so a step does not grow with the number of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import map_batches, table

LENGTH = 2048
END_ID = 0
#: Pieces that one partition packs together; more are packed in several such blocks, in bounded memory. Every piece is placed; a
#: block's last sequences may stay part empty (measured on 400,000 pieces: 38,454 sequences in one block, 38,456 in eight, 38,452.98 at least).
PACK_BLOCK = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenise(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32.

    Null and empty texts have the end id alone, very long ones are cut but lose nothing. Repeated rows give repeated pieces, ids may be
    null or repeat and come back as they are. Other columns are not read; an empty table gives an empty one.
    """

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from lodestone.llm.bpe import encoder

        enc, doc_ids, column = encoder(path), batch.column(0), batch.column(1)
        parts: list[list[np.ndarray]] = []
        lo, texts, chars = 0, [], 0
        for at, text in enumerate(column.to_pylist()):
            texts.append(text or "")
            chars += len(texts[-1])
            if chars >= 1_000_000 or at + 1 == len(column):
                parts.append(_pieces(enc, texts, lo, length, end_id))
                lo, texts, chars = at + 1, [], 0
        row, piece, start, size, crc = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield pa.RecordBatch.from_arrays(
            [doc_ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), pa.array(crc)],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), one, PIECES)


def _pieces(enc, texts: list[str], row: int, length: int, end_id: int) -> list[np.ndarray]:
    ids, off = enc.ids(texts)
    total = np.diff(off) + 1
    ids = np.insert(ids, off[1:], end_id).astype("<u4")
    off = np.concatenate(([0], np.cumsum(total)))
    count = (total + length - 1) // length
    owner = np.repeat(np.arange(len(texts)), count)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    ends = total[owner] - (count[owner] - 1 - piece) * length
    start = np.maximum(ends - length, 0)
    raw = memoryview(ids.tobytes())
    lo, hi = 4 * (off[owner] + start), 4 * (off[owner] + ends)
    crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.int64, len(owner))
    return [owner + row, piece, start, ends - start, crc]


def best_two_fit(lengths: np.ndarray, capacity: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each length, all of 1 to capacity. Ties keep the order of the input."""
    order = np.argsort(lengths, kind="stable")
    counts = np.bincount(lengths, minlength=capacity + 1)
    nxt = np.concatenate(([0], np.cumsum(counts)))[: capacity + 1].tolist()  # the next unused piece of each length, in order
    left = counts.tolist()
    present = 0
    for size in np.flatnonzero(counts).tolist():
        present |= 1 << size

    def take(size: int) -> None:
        nonlocal present
        left[size] -= 1
        if not left[size]:
            present &= ~(1 << size)

    bins, slot, place = 0, np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    while present:
        inside: list[int] = []
        gap = capacity
        while size := (present & ((1 << gap + 1) - 1)).bit_length():
            size -= 1
            take(size)
            inside.append(size)
            gap -= size
            if not gap:
                break
        if gap and present and len(inside) > 1:
            small = inside[-1]
            room = gap + small
            best = (small, 0, 0)
            a = (present & ((1 << room) - 1)).bit_length() - 1
            while a > 0 and 2 * a >= best[0]:
                b = (present & ((1 << min(room - a, a) + 1) - 1)).bit_length() - 1
                if b == a and left[a] < 2:
                    b = (present & ((1 << a) - 1)).bit_length() - 1
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == room:
                        break
                a = (present & ((1 << a) - 1)).bit_length() - 1
            if best[1]:
                inside.pop()
                left[small] += 1
                present |= 1 << small
                for size in best[1:]:
                    take(size)
                    inside.append(size)
        at = 0
        for size in inside:
            k = order[nxt[size]]
            nxt[size] += 1
            slot[k], place[k] = bins, at
            at += size
        bins += 1
    return slot, place


def pack(pieces: DataFrame, length: int = LENGTH, by: str = "doc_id", block: int = PACK_BLOCK) -> DataFrame:
    """pieces with sequence_id and offset: no sequence holds over `length` tokens, offsets are gapless from 0.

    Pieces of one document may go to different sequences. Rows that are equal are placed apart, in any order; columns come back as
    they are, nulls included. An empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, held, rows = TaskContext.get().partitionId() << 40, [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                out, base = _packed(held, base, length, by)
                yield from out
                held, rows = [], 0
        if rows:
            yield from _packed(held, base, length, by)[0]

    # No number of partitions: AQE merges small ones, as each last sequence of a partition may stay part empty.
    dealt = pieces.repartition(F.xxhash64(by, "piece"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def _packed(held: list[pa.RecordBatch], base: int, length: int, by: str) -> tuple[list[pa.RecordBatch], int]:
    # Sorted, so that the result does not depend on the order in which rows came.
    rows = pa.Table.from_batches(held).sort_by([(by, "ascending"), ("piece", "ascending"), ("length", "ascending")]).combine_chunks()
    slot, place = best_two_fit(rows["length"].to_numpy(), length)
    rows = rows.append_column("sequence_id", pa.array(base + slot)).append_column("offset", pa.array(place))
    return rows.to_batches(), base + int(slot.max()) + 1


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(tokenise(docs, path, length), length)


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
