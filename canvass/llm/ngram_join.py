"""Exact Jaccard self-join of documents on word shingles, as connected groups.

Jaccard distance is a metric, and inside a family of similar texts pivots cut it well. Over a
whole corpus they don't: almost all distances are close to 1, so that every document would lie in
the window of every Voronoi region. Hence two levels:

1. Families. Shingles are dealt by hash into m classes. Two sets that are similar enough differ in
   fewer than m shingles, so they agree on a whole class; equal classes link documents into
   families, without loss. m follows from the sizes; a set with too many empty classes is dealt
   again with another seed, as a shared empty class says nothing. Signatures of classes go through
   a pair of Bloom filters, packed, and only those that may occur twice are looked at. Families are
   then formed anew, by the shingles that are rare in them: two sets that link share one of the
   rarest of either, again without loss, whereas a passage that very many texts have links nothing.
   Members that share too few of their shingles to link with anyone leave.
2. Regions. All links come from here. Pivots cut a family: each member goes to the region of its
   nearest pivot and, by the triangle inequality, also to each region whose pivot is at most
   2 epsilon further, so a link is found in at least one region. Regions are cut again until
   they are small. A family that fits one task is joined there; a larger one is cut by pivots in
   rounds over the cluster. There, members within epsilon of a pivot are linked through it already,
   and so are pivots that share such a member; a region is visited, and a member replicated, only
   where that leaves two groups apart. Regions that are still large after ROUNDS are joined block
   against block.

Sets are of 64-bit shingle hashes. Equal sets are one class, known by a 128-bit hash and numbered;
classes are what is linked, and ids come in only at the end.

Defined cases: null or empty text has no shingles and links with nothing, not even with its like;
a text of fewer words than the shingle is one shingle; rows that repeat an id are documents of
their own and may be in different groups; rows with a null id link with nothing; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import answer, asks, ranges_for
from .components import Groups, components
from .packed import pack, small, unpack
from .storage import discard, fresh, option, written
from .workers import lean

#: A family or region of at most so many shingles and members is joined in one task.
REGION_SHINGLES = 3_000_000
REGION_MEMBERS = 3000
PIVOTS = 12
#: Members of a region that are measured against its pivots in one task.
CHUNK_MEMBERS, CHUNK_SHINGLES = 1000, 1_000_000
ROUNDS = 4
SEEDS = 6
LOCAL_PIVOTS = 6
#: Inside a task, a region of so many members is compared pair by pair.
LEAF = 12
#: A block of documents is closed beyond so many signatures.
BLOCK_SIGNATURES = 500_000
#: Few keys are dealt to fewer ranges than there are partitions, as a range has a row for each block.
LEAST_RANGE = 500_000
#: Bits that signatures do without; of a thousand million, one in 300,000 is then taken for another, which joins two families and loses nothing.
SPARE = np.uint64(16)

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(raw: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles of a UTF-8 text, A-Z in lower case."""
    words = raw.lower().split() if raw else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(size, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            acc = _mix(acc * _A + h[j : n - k + 1 + j])
    return np.unique(acc)


class Bands:
    """Size bands and numbers of classes for a least similarity of num/den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.starts = [1]

    def band(self, n: int) -> int:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    @lru_cache(maxsize=None)  # noqa: B019 - one object lives as long as its process
    def classes(self, band: int) -> tuple[int, int]:
        """(m, slack) for pairs whose smaller set is in ``band``: at most m - slack - 1 shingles
        differ, so with at most ``slack`` common empty classes some other class is equal."""
        self.band(max(self.starts[min(band, len(self.starts) - 1)], 1))
        while len(self.starts) <= band + 1:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)
        first, last = self.starts[band], self.starts[band + 1] - 1
        differ = last * (self.den - self.num) // self.num
        if differ == 0:
            return 1, 0
        for slack in range(1, differ + 2):
            m = differ + 1 + slack
            if m * math.exp(-first / m) <= 0.8 * slack:  # empty classes to be expected
                break
        return m, slack

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """64-bit signatures of the classes of a set, for its own band and the one below."""
        own = self.band(len(shingles))
        out = []
        with np.errstate(over="ignore"):
            for band in {own, max(0, own - 1)}:
                m, slack = self.classes(band)
                if m == 1:
                    continue  # only equal sets can link
                for seed in range(SEEDS):
                    mixed = _mix(shingles + np.uint64(seed + 1) * _A)
                    place = ((mixed >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
                    filled = np.bincount(place, minlength=m) > 0
                    total = np.zeros(m, np.uint64)
                    np.add.at(total, place, _mix(mixed + _B))
                    key = _mix(total + _mix(np.arange(m, dtype=np.uint64) * _A + np.uint64(band * SEEDS + seed)))
                    enough = m - int(filled.sum()) <= slack
                    out.append(key[filled] if enough or seed < SEEDS - 1 else key)
                    if enough:
                        break
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def join_region(sets: list[np.ndarray], num: int, den: int, roots: list[int | None] | None = None) -> list[tuple[int, int]]:
    """Links that span the groups of a family, exactly, by Voronoi regions within regions. Members
    with the same root are linked through it. A pair is compared unless it is known to be in one
    group already, or sizes, pivots or regions prove it too far apart. A set is compared with many
    at once: its shingles are marked, and marks are counted along the others."""
    sizes = np.array([len(s) for s in sets])
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True) if sets else (sizes, sizes)
    flat, starts = flat.astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    marked = np.zeros(len(distinct), np.uint8)
    group, links = np.arange(len(sets)), []
    first: dict[int, int] = {}
    for k, root in enumerate(roots or ()):
        if root is not None:
            group[k] = first.setdefault(root, k)
    epsilon = 1 - num / den

    def along(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The shingles of members one after the other, and where each begins."""
        begins = np.concatenate([[0], np.cumsum(sizes[members])])
        return np.concatenate([flat[starts[m] : starts[m + 1]] for m in members.tolist()]), begins

    def compare(x: int, ys: np.ndarray, run: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Distances of x to ys, whose shingles are ``run``; those within epsilon are linked."""
        own = flat[starts[x] : starts[x + 1]]
        marked[own] = 1
        both = np.add.reduceat(marked[run], begins, dtype=np.int64)
        marked[own] = 0
        union = sizes[x] + sizes[ys] - both
        for y in ys[both * den >= union * num].tolist():
            if group[x] != group[y]:
                links.append((x, y))
                group[group == group[y]] = group[x]
        return 1 - both / union

    def by_pairs(members: np.ndarray, far: np.ndarray) -> None:
        order = np.argsort(sizes[members], kind="stable")
        ordered, far = members[order], far[:, order]
        size = sizes[ordered]
        run, begins = along(ordered)
        for k, x in enumerate(ordered.tolist()):
            end = int(np.searchsorted(size, size[k] * den // num, side="right"))
            near = k + 1 + np.flatnonzero(group[ordered[k + 1 : end]] != group[x])
            if len(near) and len(far):
                near = near[(np.abs(far[:, near] - far[:, [k]]) <= epsilon + 1e-9).all(0)]
            if 2 * len(near) > end - k - 1:
                compare(x, ordered[k + 1 : end], run[begins[k + 1] : begins[end]], begins[k + 1 : end] - begins[k + 1])
            elif len(near):
                some, at = along(ordered[near])
                compare(x, ordered[near], some, at[:-1])

    def region(members: np.ndarray) -> None:
        if len(members) <= LEAF:
            by_pairs(members, np.zeros((0, len(members))))
            return
        # Each pivot is the member farthest from the ones before it.
        at, least, far = int(sizes[members].argmax()), np.full(len(members), np.inf), []
        run, begins = along(members)
        for _ in range(LOCAL_PIVOTS):
            far.append(compare(int(members[at]), members, run, begins[:-1]))
            least = np.minimum(least, far[-1])
            at = int(least.argmax())
            if least[at] <= epsilon:
                break
        del run
        far = np.array(far)
        if (group[members] == group[members[0]]).all():
            return
        home = far.min(0)
        windows = [np.flatnonzero(d <= home + 2 * epsilon + 1e-9) for d in far]
        if 2 * sum(len(w) ** 2 for w in windows) > len(members) ** 2:  # every cut at least halves the pairs; else regions prune less than the pivots' distances
            by_pairs(members, far)
            return
        for inside in windows:
            region(members[inside])

    if sets:
        region(np.arange(len(sets)))
    return links


LINK = "a bigint, b bigint"


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})


def _joined_whole(members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links of regions (region, doc, raw, root) that each fit one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, docs, sets, roots = None, [], [], []

        def done() -> pa.RecordBatch:
            return _links([(docs[x], docs[y]) for x, y in join_region(sets, num, den, roots)])

        for batch in batches:
            for r, doc, raw, root in zip(*(batch.column(c).to_pylist() for c in ("region", "doc", "raw", "root")), strict=True):
                if r != region and docs:
                    yield done()
                    docs, sets, roots = [], [], []
                region = r
                docs.append(doc)
                sets.append(shingle_set(raw, words))
                roots.append(root)
        if docs:
            yield done()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return members.select("region", "doc", "raw", "root").repartition(parts, "region").sortWithinPartitions("region", "doc").mapInArrow(lean(run), LINK)


def _pivots(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """(region, pivots): about PIVOTS members of each region, by hash; the one of least hash at least."""
    tagged = members.join(sizes.select("region", F.col("members").alias("size")), "region")
    chance = F.pmod(F.xxhash64("doc", "region"), F.greatest(F.floor(F.col("size") / PIVOTS), F.lit(1)))
    picked = tagged.where(chance == 0).select("region", "doc", "raw")
    least = tagged.groupBy("region").agg(F.min_by(F.struct("doc", "raw"), F.struct(F.xxhash64("doc"), "doc")).alias("p")).select("region", "p.doc", "p.raw")
    return picked.unionByName(least).dropDuplicates(["region", "doc"]).groupBy("region").agg(F.sort_array(F.collect_list(F.struct("doc", "raw"))).alias("pivots"))


def _distances(own: np.ndarray, pivots: list[tuple[int, np.ndarray]], num: int, den: int) -> tuple[np.ndarray, list[int], int]:
    """(distance of a set to each pivot, pivots within epsilon, nearest pivot)."""
    d, linked = [], []
    for k, (_, other) in enumerate(pivots):
        both = _common(own, other)
        union = len(own) + len(other) - both
        d.append(1 - both / union)
        if both * den >= union * num:
            linked.append(k)
    return np.array(d), linked, int(np.argmin(d))


def _beside_pivots(members: DataFrame, pivots: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members dealt in chunks of their region, each chunk behind the pivots of its region; no task
    gets more of a region than its chunks, and no row carries the pivots."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = sizes.select("region", F.ceil(F.greatest(F.col("members") / CHUNK_MEMBERS, F.col("total") / CHUNK_SHINGLES)).cast("bigint").alias("chunks"))
    blank = F.lit(None).cast("array<bigint>")
    dealt = members.join(chunks, "region").select("region", F.pmod(F.xxhash64("doc"), F.col("chunks")).alias("chunk"), F.lit(1).alias("kind"), "doc", "raw", blank.alias("pairs"))
    copies = pivots.join(chunks, "region").select("region", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), "pivots", "pairs")
    copies = copies.select("region", "chunk", F.lit(0).alias("kind"), F.inline("pivots"), "pairs").select("region", "chunk", "kind", "doc", "raw", "pairs")
    return copies.unionAll(dealt).repartition(parts, "region", "chunk").sortWithinPartitions("region", "chunk", "kind", "doc")


def _each_member(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[tuple]]:
    """By batch: (region, doc, raw, set, pivots, pairs) of its members, from rows of _beside_pivots; a pivot is (doc, set)."""
    at, pivots, pairs = None, [], ()
    for batch in batches:
        out = []
        for region, chunk, kind, doc, raw, linked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (region, chunk) != at:
                at, pivots, pairs = (region, chunk), [], linked or ()
            if kind == 0:
                pivots.append((doc, shingle_set(raw, words)))
            else:
                out.append((region, doc, raw, shingle_set(raw, words), pivots, pairs))
        yield out


def _cut_by_pivots(members: DataFrame, sizes: DataFrame, words: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """One round over large regions: links to pivots (a, b), and the members of the open regions
    of the next round (region, doc, raw, n, root)."""
    epsilon = 1 - num / den
    pivots = written(_pivots(members, sizes), "pivots")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int, int]] = set()
        for rows in _each_member(batches, words):
            out = []
            for region, doc, _, own, pivot, _ in rows:
                _, linked, home = _distances(own, pivot, num, den)
                pairs = {(region, linked[0], k) for k in linked[1:]} - met if linked else set()
                met |= pairs
                out.append((region, doc, home, pivot[home][0], home in linked, [x * 65536 + y for _, x, y in pairs]))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["region", "doc", "home", "pivot", "near", "pairs"])

    none = F.lit(None).cast("array<bigint>").alias("pairs")
    at_home = written(_beside_pivots(members, pivots.select("region", "pivots", none), sizes).mapInArrow(lean(measure), "region bigint, doc bigint, home int, pivot bigint, near boolean, pairs array<bigint>"), "homes")
    links = at_home.where("near and doc <> pivot").select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
    pairs = at_home.select("region", F.explode("pairs").alias("pair")).groupBy("region").agg(F.collect_set("pair").alias("pairs"))
    known = pivots.join(pairs, "region", "left")
    # Pivots that share a member within epsilon: linked through it.
    joined = known.select("region", F.explode("pairs").alias("pair"), "pivots").select(F.get("pivots", F.shiftright("pair", 16).cast("int"))["doc"].alias("a"), F.get("pivots", (F.col("pair") % 65536).cast("int"))["doc"].alias("b"))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _each_member(batches, words):
            out = []
            for region, doc, raw, own, pivot, links_of in rows:
                d, linked, home = _distances(own, pivot, num, den)
                groups = Groups(len(pivot))
                for pair in links_of:
                    groups.join(pair // 65536, pair % 65536)
                near = home in linked
                for k in np.flatnonzero(d <= d[home] + 2 * epsilon + 1e-9).tolist():
                    if not near or groups.find(k) != groups.find(home):
                        out.append((region, pivot[k][0], doc, raw, len(own), pivot[home][0] if near else None))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["region", "pivot", "doc", "raw", "n", "root"])

    guests = _beside_pivots(members, known, sizes).mapInArrow(lean(replicate), "region bigint, pivot bigint, doc bigint, raw binary, n bigint, root bigint")
    visits = written(guests, "guests")
    guests = visits.select(F.xxhash64("region", "pivot").alias("next"), "doc", "raw", "n", "root")
    open_ones = guests.select("next").distinct()
    hosts = at_home.where("near").select("region", "doc", F.xxhash64("region", "pivot").alias("next"), F.col("pivot").alias("root")).join(open_ones, "next", "left_semi")
    hosts = members.drop("root").join(hosts, ["region", "doc"]).select("next", "doc", "raw", "n", "root")
    cut = written(guests.unionByName(hosts).withColumnRenamed("next", "region"), "regions")
    more = written(links.unionByName(joined), "links")
    discard(pivots, at_home, visits)
    return more, cut


def _joined_by_blocks(members: DataFrame, sizes: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The exact way for regions that pivots don't cut: every block against every other, a task each."""
    blocks = F.ceil(F.greatest(F.col("members") / REGION_MEMBERS, F.col("total") / REGION_SHINGLES) * 2).cast("bigint")
    spread = members.join(sizes.select("region", blocks.alias("blocks")), "region").withColumn("own", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    paired = spread.select("region", "doc", "raw", "root", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("other"))
    return _joined_whole(paired.select(F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("region"), "doc", "raw", "root"), words, num, den)


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.count("*").alias("members"), F.sum("n").alias("total"))


def _large() -> Column:
    return (F.col("members") > REGION_MEMBERS) | (F.col("total") > REGION_SHINGLES)


def _pairs(sizes: DataFrame) -> float:
    return float(sizes.select(F.sum(F.col("members").cast("double") ** 2)).first()[0] or 0)


def family_links(members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) spanning the groups of each family, for rows (region, doc, raw, n)."""
    # Rows of one region must meet whatever Spark infers about unions.
    with option(members.sparkSession, "spark.sql.unionOutputPartitioning", "false"):
        return written(_family_links(members, words, num, den), "family-links")


def _family_links(members: DataFrame, words: int, num: int, den: int) -> DataFrame:
    links, regions = None, members.withColumn("root", F.lit(None).cast("bigint"))
    sizes, cut = written(_sizes(regions), "region-sizes"), None
    for turn in range(ROUNDS + 1):
        big = sizes.where(_large())
        whole = written(_joined_whole(regions.join(sizes.where(~_large()).select("region"), "region"), words, num, den), "links")
        links = whole if links is None else links.unionByName(whole)
        if big.isEmpty():
            return links
        large = regions.join(big.select("region"), "region")
        by_blocks = turn == ROUNDS
        if not by_blocks:
            more, after = _cut_by_pivots(large, big, words, num, den)
            links, next_sizes = links.unionByName(more), written(_sizes(after), "region-sizes")
            # A cut that doesn't halve the pairs only copies members.
            by_blocks = 2 * _pairs(next_sizes) > _pairs(big)
            if by_blocks:
                discard(after)
        if by_blocks:
            return links.unionByName(written(_joined_by_blocks(large, big, words, num, den), "links"))
        if cut is not None:
            discard(cut)
        regions, sizes, cut = after, next_sizes, after
    return links


def _ranges(keys: int, parts: int) -> int:
    return ranges_for(keys, min(parts, -(-keys // LEAST_RANGE) or 1))


def _families(neighbours: DataFrame) -> DataFrame:
    """(node, component) of the cids of rows (sig, cid), linked by equal signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(batch.column("sig").to_numpy(), batch.column("cid").to_numpy()) for batch in batches if batch.num_rows]
        if held:
            sig, cid = (np.concatenate(c) for c in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((cid, sig))
            sig, cid = sig[order], cid[order]
            first = np.maximum.accumulate(np.where(np.r_[True, sig[1:] != sig[:-1]], np.arange(len(sig)), 0))
            least = cid[first]
            other = np.flatnonzero(least != cid)
            order = other[np.lexsort((cid[other], least[other]))]
            least, cid = least[order], cid[order]
            new = np.ones(len(cid), bool)
            new[1:] = (least[1:] != least[:-1]) | (cid[1:] != cid[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(least[new]), pa.array(cid[new])], names=["least", "cid"])

    parts = int(neighbours.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return components(neighbours.select("sig", "cid").repartition(parts, "sig").mapInArrow(lean(run), "least bigint, cid bigint"), "least", "cid")


def _exchanged(asked: DataFrame, name: str, reply: Callable[[list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Written: the rows of ``asked`` (block, span, data, others) of negative span, and what ``reply`` says of each other
    span's (block, data), as rows of span 0. What is asked goes to its range at once and is never stored."""
    others = asked.columns[3:]
    schema = asked.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span, held = None, []

        def done() -> pa.RecordBatch:
            rows = list(reply(held))
            cols = [pa.array([b for b, _ in rows], pa.int64()), pa.array([0] * len(rows), pa.int32()), pa.array([d for _, d in rows], pa.binary())]
            return pa.RecordBatch.from_arrays([*cols, *(pa.nulls(len(rows), kinds[c]) for c in others)], names=["block", "span", "data", *others])

        for batch in batches:
            kinds = {c: batch.schema.field(c).type for c in others}
            spans = batch.column("span").to_numpy()
            passing = int((spans < 0).sum())  # they come first
            if passing:
                yield batch.slice(0, passing)
            rest = batch.slice(passing)
            for block, s, data in zip(*(rest.column(c).to_pylist() for c in ("block", "span", "data")), strict=True):
                if s != span and held:
                    yield done()
                    held = []
                span = s
                held.append((block, data))
        if held:
            yield done()

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.when(F.col("span") >= 0, F.col("span").cast("bigint")).otherwise(F.xxhash64("block", *others))
    return written(asked.repartition(parts, place).sortWithinPartitions("span", "block").mapInArrow(lean(run), schema), name)


def _seen_twice(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    for block, keys, places in answer(held):
        yield block, pack(np.frombuffer(keys, "<u8"), small(np.frombuffer(places, "<i8")))


def _how_often(held: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """To each block the places of its keys that occur twice or more in all, in order, with the numbers of times."""
    distinct, times = np.unique(np.concatenate([unpack(data)[0] for _, data in held]), return_counts=True)
    for block, data in held:
        keys, places = unpack(data)
        n = times[np.searchsorted(distinct, keys)]
        hit = np.flatnonzero(n > 1)
        hit = hit[np.argsort(places[hit], kind="stable")]
        if len(hit):
            yield block, pack(places[hit].astype(np.uint64), small(n[hit]))


def _in_region(shingles: np.ndarray, region: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(shingles + _mix(np.array([region], np.int64).view(np.uint64)))


def _rare(members: DataFrame, num: int, den: int, expected: int) -> DataFrame:
    """(doc, places) for rows (region, doc, shingles): where in its set a member has the shingles by which it meets
    whom it links with. Shingles are ordered by how often their region has them; two sets that link share num/den of
    either, so they share one of the rarest n - ceil(n * num / den) + 1 of each. Passages that very many texts have are
    then not among them, and no longer make one family of unlike texts. Places are null where too few shingles occur
    twice for any link."""
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _ranges(expected, parts)
    # One key in a thousand may be taken for another: it then counts as more common, for all members alike.
    cut = np.uint64(min(24, max(0, 64 - 10 - expected.bit_length())))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        docs, keys, total = [], [], 0

        def closed() -> pa.RecordBatch:
            block = (part << 32) + number
            rows = [*asks(block, np.concatenate(keys), ranges), (block, -2, np.array(docs + [len(k) for k in keys], "<i8").tobytes())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["block", "span", "data"])

        for batch in batches:
            for region, doc, data in zip(*(batch.column(c).to_pylist() for c in ("region", "doc", "shingles")), strict=True):
                keys.append(_in_region(np.frombuffer(data, "<u8"), region) >> cut << cut)
                docs.append(doc)
                total += len(keys[-1])
                if total > BLOCK_SIGNATURES:
                    yield closed()
                    docs, keys, total, number = [], [], 0, number + 1
        if docs:
            yield closed()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, docs, n, got = None, None, None, []

        def done() -> pa.RecordBatch:
            starts = np.cumsum(n) - n
            at, times = (np.concatenate(c) for c in zip(*got, strict=True)) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            of = np.searchsorted(starts + n, at, side="right")
            hits = np.bincount(of, minlength=len(n))
            wanted = hits + (-n * num) // den + 1  # the others of the rarest occur once
            order = np.lexsort((at, times, of))
            rank = np.arange(len(order)) - np.repeat(np.cumsum(hits) - hits, hits)
            taken = order[rank < wanted[of[order]]]
            taken = taken[np.argsort(at[taken], kind="stable")]
            found = np.split((at[taken] - starts[of[taken]]).astype("<u4"), np.cumsum(np.bincount(of[taken], minlength=len(n)))[:-1])
            places = [x.tobytes() if w > 0 else None for x, w in zip(found, wanted.tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(docs), pa.array(places, pa.binary())], names=["doc", "places"])

        for batch in batches:
            for b, span, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if span == -2:
                    if block is not None:
                        yield done()
                    values = np.frombuffer(data, "<i8")
                    block, docs, n, got = b, values[: len(values) // 2], values[len(values) // 2 :], []
                else:
                    assert b == block
                    at, times = unpack(data)
                    got.append((at.astype(np.int64), times.astype(np.int64)))
        if block is not None:
            yield done()

    told = _exchanged(members.select("region", "doc", "shingles").mapInArrow(lean(ask), "block bigint, span int, data binary"), "shingle-asks", _how_often)
    out = written(told.repartition(parts, "block").sortWithinPartitions("block", "span").mapInArrow(lean(judge), "doc bigint, places binary"), "lonely")
    discard(told)
    return out


def _lonely(members: DataFrame, num: int, den: int) -> DataFrame:
    """Docs of rows (region, doc, shingles) that link with nothing: whoever links shares num/den of
    its shingles with the other, but fewer of theirs occur twice in their region."""
    expected = int(members.select(F.sum(F.length("shingles"))).first()[0] or 0) // 8
    return _rare(members, num, den, expected).where("places is null").select("doc")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row; links are Jaccard >= num/den."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    # A plan for the filters: a word has about six bytes and gives (den - num) / num signatures for each of two bands.
    expected = int((rows.select(F.sum(F.length("raw"))).first()[0] or 0) / 6 * 2.5 * (den - num) / num)
    ranges = _ranges(expected, parts)
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
    names = ["block", "span", "data", "doc_id", "n_shingles", "key"]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (span -1); for each block, what it asks of the filters and its classes (span -2)."""
        bands = Bands(num, den)
        part, number = TaskContext.get().partitionId(), 0
        met: dict[bytes, int] = {}
        sigs: list[np.ndarray] = []
        total = 0

        def closed() -> pa.RecordBatch:
            block = (part << 32) + number
            asked = asks(block, np.concatenate(sigs) >> SPARE << SPARE, ranges)
            # Classes of the block in order with the number of their signatures, to find a signature's class by its place.
            table = b"".join(met) + np.array([len(x) for x in sigs], "<i8").tobytes()
            asked.append((block, -2, table))
            cols = [*zip(*asked, strict=True)]
            blank = [None] * len(asked)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols, blank, blank, blank], kinds, strict=True)], names=names)

        for batch in batches:
            docs_of, n, keys = batch.column(0).to_pylist(), [], []
            for doc, raw in zip(docs_of, batch.column(1), strict=True):
                s = shingle_set(raw.as_py(), words)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s) and doc is not None and keys[-1] not in met:
                    met[keys[-1]] = len(met)
                    sigs.append(bands.signatures(s))
                    total += len(sigs[-1])
                    if total > BLOCK_SIGNATURES:
                        yield closed()
                        met, sigs, total, number = {}, [], 0, number + 1
            size = len(n)
            blank = [None] * size
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([blank, [-1] * size, blank, docs_of, n, keys], kinds, strict=True)], names=names)
        if sigs:
            yield closed()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cids, ends = None, None, None
        for batch in batches:
            for b, span, data in zip(*(batch.column(c).to_pylist() for c in ("block", "span", "data")), strict=True):
                if span == -2:
                    n = len(data) // 24
                    block, cids, ends = b, np.frombuffer(data, ">u8", 2 * n)[::2].astype(np.uint64), np.cumsum(np.frombuffer(data, "<i8", n, 16 * n))
                    continue
                assert b == block
                keys, places = unpack(data)
                of = np.searchsorted(ends, places, side="right")
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array((cids[of] ^ np.uint64(1 << 63)).view(np.int64))], names=["sig", "cid"])

    def of_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members once, with their texts; a text takes a third of the room of its set."""
        rep, met = None, set()
        for batch in batches:
            out = []
            for region, doc, key, of, raw in zip(*(batch.column(c) for c in ("region", "doc", "key", "rep", "raw")), strict=True):
                if of.as_py() != rep:
                    rep, met = of.as_py(), set()
                s = shingle_set(raw.as_py(), words)
                if doc.as_py() not in met and xxhash.xxh3_128_digest(s.tobytes()) == key.as_py():
                    met.add(doc.as_py())
                    out.append((region.as_py(), doc.as_py(), len(s), raw.as_py()))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["region", "doc", "n", "raw"])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [shingle_set(raw.as_py(), words).tobytes() for raw in batch.column("raw")]
            yield pa.RecordBatch.from_arrays([batch.column("region"), batch.column("doc"), pa.array(data, pa.binary())], names=["region", "doc", "shingles"])

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, cids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for region, doc, raw, places in zip(*(batch.column(c) for c in ("region", "doc", "raw", "places")), strict=True):
                sigs.append(_in_region(shingle_set(raw.as_py(), words)[np.frombuffer(places.as_py(), "<u4")], region.as_py()))
                cids.append(np.full(len(sigs[-1]), doc.as_py(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(cids))], names=["sig", "cid"])

    gathered = _exchanged(rows.mapInArrow(lean(gather), "block bigint, span int, data binary, doc_id bigint, n_shingles bigint, key binary"), "shingle-blocks", _seen_twice)
    neighbours = written(gathered.where("span <> -1").select("block", "span", "data").repartition(parts, "block").sortWithinPartitions("block", "span").mapInArrow(lean(suspects), "sig bigint, cid bigint"), "signature-suspects")
    summary = written(gathered.where("span = -1").select("doc_id", "n_shingles", "key"), "summary")
    discard(gathered)
    families = _families(neighbours)
    discard(neighbours)
    classes = summary.where("doc_id is not null and key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"))
    classes = written(classes.withColumn("doc", F.monotonically_increasing_id()), "set-classes")
    chosen = written(classes.withColumn("node", _cid("key")).join(families, "node").select(F.col("component").alias("region"), "doc", "key", "rep"), "family-members")
    # A merge join at any size: the cost then follows the input, and nothing is broadcast. Rows that repeat an id with other texts drop out by key.
    # Rows of an id come one after the other; where Spark has split them, a set may come twice, which costs time and changes no link.
    own = rows.hint("merge").join(chosen.hint("merge"), rows.doc_id == chosen.rep).select("region", "doc", "key", "rep", "raw").mapInArrow(lean(of_class), "region bigint, doc bigint, n bigint, raw binary")
    found = written(own, "family-sets")
    # Families anew, of members that meet by a rare shingle.
    rare = _rare(found.mapInArrow(lean(with_sets), "region bigint, doc bigint, shingles binary"), num, den, int(found.select(F.sum("n")).first()[0] or 0))
    meeting = found.join(rare.where("places is not null"), "doc").select("region", "doc", "raw", "places")
    live = written(meeting.mapInArrow(lean(rarest), "sig bigint, cid bigint"), "live-members")
    families = _families(live)
    discard(live)
    members = written(found.drop("region").join(families.select(F.col("node").alias("doc"), F.col("component").alias("region")), "doc").select("region", "doc", "n", "raw"), "families")
    discard(found)
    roots = components(family_links(members, words, num, den), "a", "b")
    linked = written(roots.join(classes.select(F.col("doc").alias("node"), "key", "rep"), "node"), "linked-classes")
    least_id = written(linked.groupBy("component").agg(F.min("rep").alias("least_id")), "groups")
    labelled = classes.join(linked.join(least_id, "component").select("key", "least_id"), "key", "left").select("key", F.coalesce("least_id", "rep").alias("least_id"))
    # Written, so that the join shuffles both of its sides and a text of very many copies can be split; rows without a class don't meet in it.
    classed = F.col("key").isNotNull() & F.col("doc_id").isNotNull()
    out = summary.where(classed).join(written(labelled, "class-groups"), "key", "left").select("doc_id", "n_shingles", F.coalesce("least_id", "doc_id").alias("component_id"))
    return out.unionAll(summary.where(~classed).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _cid(key: str) -> Column:
    """The first 8 bytes of a hash, big-endian, less 2**63, as bigint."""
    half = lambda at: F.conv(F.hex(F.substring(key, at, 4)), 16, 10).cast("bigint")
    return (half(1) - F.lit(1 << 31)) * F.lit(1 << 32) + half(5)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """``docs`` with the row of least id of each group; texts without words and null ids stay."""
    groups = similar_groups(docs, id_col, text_col, words, num, den).where("doc_id <> component_id").select(F.col("doc_id").alias(fresh(docs.columns, "dropped"))).distinct()
    return docs.hint("merge").join(groups.hint("merge"), F.col(id_col) == groups[groups.columns[0]], "left_anti")
