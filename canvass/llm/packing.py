"""Best-two-fit packing of token sequences, on the histogram of their lengths.

Only lengths matter for packing, and there are at most ``capacity`` of them. The driver packs
the histogram: it fills a bin greedily, largest fitting length first, then replaces the bin's
smallest document by two unpacked ones that fit its widened gap more tightly; the bin found is
used as often as the counts allow. Each step uses up a length, so the work on the driver
depends on the capacity, not on the number of documents. Documents get their places by their
rank among those of equal length, from counts per input partition and prefix sums; no length
is gathered in one task, however many documents share it.

Defined cases: null text is empty; an empty document is its end token alone; documents of equal
length are interchangeable; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import written
from .tokens import load
from .workers import lean

CAPACITY = 4096
END_ID = 1


def pack_lengths(counts: np.ndarray) -> list[tuple[list[int], int]]:
    """Bins as (lengths in order of offset, how many such bins), for counts[length]."""
    left = counts.astype(np.int64).copy()
    capacity = len(left) - 1
    bins: list[tuple[list[int], int]] = []
    #: below[x]: the largest length that is left and at most x, 0 if none.
    below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
    while below[capacity]:
        used: dict[int, int] = {}
        gap, length = capacity, int(below[capacity])
        while length:
            k = min(gap // length, int(left[length]))
            used[length] = k
            gap -= k * length
            length = int(below[min(gap, length - 1)])
        while gap:
            small = min(used)
            room = gap + small
            free = np.flatnonzero(left[: room + 1] - np.array([used.get(i, 0) for i in range(room + 1)]) > 0)
            free = free[free > 0]
            if not len(free):
                break
            at = np.zeros(room + 1, np.int64)
            at[free] = free
            at = np.maximum.accumulate(at)
            first = free[free < room]
            second = at[room - first]
            total = first + second
            # The same length twice needs two documents of it.
            short = (first == second) & (left[first] - np.array([used.get(int(i), 0) for i in first]) < 2)
            second = np.where(short, at[np.maximum(first - 1, 0)], second)
            total = np.where(second > 0, first + second, 0)
            if not len(total) or total.max() <= small:
                break
            k = int(total.argmax())
            used[small] -= 1
            if not used[small]:
                del used[small]
            for x in (int(first[k]), int(second[k])):
                used[x] = used.get(x, 0) + 1
            gap = room - int(total[k])
        times = min(int(left[x]) // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= k * times
        bins.append(([x for x in sorted(used, reverse=True) for _ in range(used[x])], times))
        below = np.maximum.accumulate(np.where(left > 0, np.arange(capacity + 1), 0))
    return bins


class _Places:
    """Where the r-th piece of each length goes; sorted arrays, bounded by the bins found."""

    def __init__(self, bins: list[tuple[list[int], int]], capacity: int) -> None:
        taken = np.zeros(capacity + 1, np.int64)
        rows = []
        sequence = 0
        for lengths, times in bins:
            offset, slots = 0, {}
            for x in lengths:
                slots.setdefault(x, []).append(offset)
                offset += x
            for x, at in slots.items():
                rows.append((x, int(taken[x]), sequence, len(at), at[0]))
                taken[x] += times * len(at)
            sequence += times
        rows.sort()
        self.length, self.rank, self.sequence, self.per_bin, self.offset = (np.array([r[i] for r in rows], np.int64) for i in range(5))
        self.sequences = sequence
        self.stride = int(taken.max()) + 1 if len(rows) else 1

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row = np.searchsorted(self.length * self.stride + self.rank, length * self.stride + rank, side="right") - 1
        turn = rank - self.rank[row]
        return self.sequence[row] + turn // self.per_bin[row], self.offset[row] + turn % self.per_bin[row] * length


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """Written rows (doc_id, piece, start, length, ids_crc32, part, nth): nth counts the pieces of
    the same length before this one in the same input partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = load(tokenizer)
        part = TaskContext.get().partitionId()
        met = np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([encoder.encode(text.as_py() or ""), end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    rows.append((doc, piece, start, len(cut), zlib.crc32(cut.tobytes()), part, int(met[len(cut)])))
                    met[len(cut)] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    rows = docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string"))
    return written(rows.mapInArrow(lean(run), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"), "pieces")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row for each piece."""
    spark = docs.sparkSession
    pieces = token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id)
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        total[r.length] = r.n
    places = spark.sparkContext.broadcast(_Places(pack_lengths(total), capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = places.value.find(length, rank) if len(length) else (length, rank)
            cols = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bases, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(lean(place), "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
