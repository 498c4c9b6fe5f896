"""Blockwise suffix sorting with a difference cover, for finding equal strings of one length.

A block is the text of some suffix buckets. Positions whose residue modulo v is in a difference
cover are the sample; of any two positions, both reach the sample after the same delta < v bytes.
Samples are ranked first: by their v bytes, then by doubling along steps of v, which lead from
sample to sample. The suffixes of a block are then sorted by their first v bytes; where these (and
the last bytes of the strings asked for) tie, the ranks of the two samples delta further decide.
All comparisons are of bytes or of ranks made from bytes. Working memory is a few arrays of the
block's size.
"""

from __future__ import annotations

from functools import cmp_to_key, lru_cache

import numpy as np

#: Ties are resolved against one suffix of each bucket in turn; so many turns, then by sorting.
TURNS = 8


def cover(v: int) -> np.ndarray:
    """About 2 sqrt(v) residues whose differences give every residue modulo v."""
    r = int(np.ceil(np.sqrt(v)))
    return np.array(sorted({*range(min(r, v)), *(k * r % v for k in range(1, -(-v // r) + 1))}))


@lru_cache(maxsize=8)
def _tables(v: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cover, place of each residue in it or -1, the least delta for each pair of residues)."""
    chosen = cover(v)
    place = np.full(v, -1)
    place[chosen] = np.arange(len(chosen))
    delta = np.full((v, v), -1)
    for d in range(v - 1, -1, -1):
        hit = place[(np.arange(v) + d) % v] >= 0
        delta[np.ix_(hit, hit)] = d
    return chosen, place, delta


def _ranked(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys from 1; 0 stands for what lies beyond the end."""
    if not len(keys):
        return keys.astype(np.uint64)
    order = np.argsort(keys)
    ordered = keys[order]
    out = np.empty(len(keys), np.uint64)
    out[order] = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])]).astype(np.uint64)
    return out


def _with(first: np.ndarray, second: np.ndarray, step: int) -> np.ndarray:
    """Ranks by ``first`` and then by ``second`` ``step`` places further."""
    top = np.uint64(int(second.max(initial=0)) + 1)
    behind = np.zeros(len(first), np.uint64)
    behind[: max(0, len(first) - step)] = second[step:]
    return _ranked(first * top + behind)


def _ranks_of_bytes(data: np.ndarray, v: int) -> np.ndarray:
    """Ranks of all positions by their next v bytes; v is a power of two."""
    width = min(v, 8)
    wide = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    keys = np.zeros(len(data), np.uint64)
    for k in range(width):
        keys = (keys << np.uint64(8)) | wide[k : k + len(data)]
    ranks = _ranked(keys)
    while width < v:
        ranks = _with(ranks, ranks, width)
        width *= 2
    return ranks


class Sample:
    """Ranks of the cover sample of a block by ``steps`` times v bytes."""

    def __init__(self, prefix: np.ndarray, v: int, steps: int) -> None:
        self.v = v
        chosen, self.place, self.delta = _tables(v)
        self.per = len(chosen)
        at = (np.arange(-(-len(prefix) // v))[:, None] * v + chosen).ravel()
        ranks = np.where(at < len(prefix), prefix[np.minimum(at, len(prefix) - 1)], np.uint64(0))
        powers, have = {1: ranks}, 1
        while 2 * have <= steps:
            powers[2 * have] = _with(powers[have], powers[have], have * self.per)
            have *= 2
        self.ranks = powers[have]
        for k in sorted(powers, reverse=True):
            while have + k <= steps:
                self.ranks = _with(self.ranks, powers[k], have * self.per)
                have += k

    def of(self, at: np.ndarray) -> np.ndarray:
        return self.ranks[at // self.v * self.per + self.place[at % self.v]]

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Signs of the order of pairs of suffixes whose first v bytes tie."""
        d = self.delta[a % self.v, b % self.v]
        x, y = self.of(a + d), self.of(b + d)
        return (x > y).astype(np.int8) - (x < y).astype(np.int8)


def repeated_starts(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of the strings of ``length`` bytes at ``starts`` (distinct) occur at two of them or more."""
    out = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return out
    v = 1
    while v < 64 and 8 * v <= length:
        v *= 2
    prefix = _ranks_of_bytes(data, v)
    # delta + steps * v stays within the string; what is left is under 2 v bytes, which two ranks cover.
    steps = max(1, (length - v + 1) // v)
    tail = length - v
    alike = np.arange(len(starts))
    bucket = np.zeros(len(starts), np.uint64)
    for offset in (0, tail, min(steps * v, tail)):
        own = prefix[starts[alike] + offset]
        bucket = _ranked(bucket * np.uint64(int(own.max()) + 1) + own)
        size = np.bincount(bucket.astype(np.int64))
        keep = size[bucket.astype(np.int64)] > 1
        alike, bucket = alike[keep], bucket[keep]
        if not len(alike):
            return out
    sample = Sample(prefix, v, steps)
    order = np.argsort(bucket, kind="stable")
    alike, bucket = alike[order], bucket[order]
    for _ in range(TURNS):
        first = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1])
        sizes = np.diff(np.append(first, len(bucket)))
        head = np.repeat(first, sizes)
        same = sample.differ(starts[alike], starts[alike[head]]) == 0
        out[alike[same & (np.add.reduceat(same, first, dtype=np.int64) > 1).repeat(sizes)]] = True
        alike, bucket = alike[~same], bucket[~same]
        if not len(alike):
            return out
    # Buckets of many different strings: sorted, with the sample's ranks as the order.
    edges = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    one = lambda x, y: int(sample.differ(starts[[x]], starts[[y]])[0])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        ordered = sorted(alike[a:b].tolist(), key=cmp_to_key(one))
        for x, y in zip(ordered[:-1], ordered[1:], strict=True):
            if one(x, y) == 0:
                out[[x, y]] = True
    return out
