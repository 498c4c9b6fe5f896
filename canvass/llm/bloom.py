"""A pair of Bloom filters, for keys seen once and keys seen twice, by range of the hash.

Whoever looks for repeated keys cuts its input into blocks and sends each range of hashes the
block's keys in it, as one packed row (``asks``). The owner of a range fills its two filters block
by block and then answers each block with the places of its keys that were seen twice. The number
of ranges follows the number of keys, so a filter keeps its size and its rate of false positives
at any size of the input, and nothing is broadcast or sent to the driver. A key that is very
common comes once from each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .packed import bounds, pack, small, unpack
from .storage import written
from .workers import lean

#: Keys that a range is planned for, and the bits of a filter for each; both filters and the packed keys of a range are held by one task.
RANGE_KEYS = 8_000_000
BITS_PER_KEY = 12
PROBES = 3
LEAST_BITS = 1 << 16

ASK = "block bigint, span int, data binary"
FOUND = "block bigint, keys binary, places binary"


def ranges_for(keys: int, parts: int) -> int:
    return max(parts, -(-keys // RANGE_KEYS))


def bits_for(keys: int) -> int:
    """Bits of a filter: a power of two."""
    return 1 << int(np.ceil(np.log2(max(LEAST_BITS, keys * BITS_PER_KEY))))


def _positions(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        mixed = keys * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        step = (mixed >> np.uint64(32)) | np.uint64(1)
        return [((mixed + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64) for i in range(PROBES)]


def put(bitmap: np.ndarray, keys: np.ndarray) -> None:
    for p in _positions(keys, len(bitmap) * 8):
        np.bitwise_or.at(bitmap, p >> 3, (1 << (p & 7)).astype(np.uint8))


def contains(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` may be in ``bitmap`` (uint8 array)."""
    found = np.ones(len(keys), bool)
    for p in _positions(keys, len(bitmap) * 8):
        found &= (bitmap[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return found


def asks(block: int, keys: np.ndarray, ranges: int) -> list[tuple[int, int, bytes]]:
    """The rows of a block for its uint64 keys, repeated ones included; a place is an index into ``keys``."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    at = bounds(ordered, ranges)
    return [(block, k, pack(ordered[at[k] : at[k + 1]], small(order[at[k] : at[k + 1]]))) for k in np.flatnonzero(np.diff(at)).tolist()]


def answer(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes, bytes]]:
    """For the (block, data) of one range: to each block its keys seen twice in all, and their places."""
    total = sum(len(unpack(data)[1]) for _, data in held)
    once, twice = np.zeros(bits_for(total) // 8, np.uint8), np.zeros(bits_for(total) // 8, np.uint8)
    for _, data in held:
        keys, counts = np.unique(unpack(data)[0], return_counts=True)
        put(twice, keys[(counts > 1) | contains(once, keys)])
        put(once, keys)
    for block, data in held:
        keys, places = unpack(data)
        hit = contains(twice, keys)
        if hit.any():
            yield block, keys[hit].tobytes(), places[hit].astype("<i8").tobytes()


def repeated(asked: DataFrame, name: str, with_keys: bool = True) -> DataFrame:
    """Written rows (block, keys, places): uint64 keys (null unless ``with_keys``) and 64-bit places of
    the keys of ``asked`` (block, span, data) that may occur twice in all. False positives are possible,
    false negatives not."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, held = None, []

        def done() -> pa.RecordBatch:
            cols = list(zip(*((block, keys if with_keys else None, places) for block, keys, places in answer(held)), strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["block", "keys", "places"])

        for batch in batches:
            for block, s, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != span and held:
                    yield done()
                    held = []
                span = s
                held.append((block, data))
        if held:
            yield done()

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = asked.select("block", "span", "data").repartition(parts, "span").sortWithinPartitions("span", "block")
    return written(dealt.mapInArrow(lean(own), FOUND), name)
