"""Katz backoff model of order three: counts, Good-Turing discounts, exactly normalised backoff weights.

Documents are cut into blocks of bounded size. A block keeps its texts as numbers into its own
sorted list of word hashes. Statistics go round as packed arrays, never as a row per n-gram:
a block sends its distinct keys and training counts to hash buckets; a bucket adds them up over
all blocks and answers each block with arrays in the block's own order. There are four such
exchanges - words; bigrams; trigrams and the backoff weights of words; backoff weights of bigrams -
and each answer is a written table partitioned by block. A token is then scored recursively: the
discounted n-gram if it was seen, else the history's backoff weight times the shorter history's
probability. All n-grams count; none is cut.

A bigram that one block alone holds is the history, or the end, of trigrams that this block alone
holds, and a bigram that training lacks, of trigrams that training lacks; both are known from
the answers on bigrams. The block counts such trigrams itself, and only the others are exchanged.
Backoff weights go back only to blocks that score an n-gram by them, which those of training
texts never are; histories go by their number in the bucket, which its first answer told.

Words, bigrams and trigrams are known by 64-bit hashes. The model's words are those of the training
texts, the end token, and one class for all others, which has the unigram mass that discounting
frees; so a history's probabilities over words, end and that class add up to one. A text's first
token has the start of a text as its whole history.

Defined cases: null or empty text is the end token alone; a null id is a training document;
without training texts the model gives each token the probability of the unknown class, 1;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import bounds as _bounds
from .packed import pack as _pack
from .packed import small as _small
from .packed import unpack as _unpack
from .storage import written
from .workers import lean

FOLDS, HELD_FOLD = 5, 1
ORDER = 3
#: Counts up to this are discounted.
KATZ_K = 5
#: A history that frees no larger share is bare: it takes one use more, which backs off.
BARE = 1e-9
#: A block is closed beyond so many tokens.
BLOCK_TOKENS = 2_200_000
#: A bucket gets about as many keys as so many blocks have.
BUCKET_BLOCKS = 2
#: Hashes that stand for the end token and for the start of a text.
END, BEGIN = np.uint64(0x0123456789ABCDEF), np.uint64(0xFEDCBA9876543210)
#: A block holds a key first, or alone.
FIRST, ALONE = 1, 2
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

ROW = "block bigint, bucket int, kind string, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["block", "bucket", "kind", "data"])


def _order(keys: np.ndarray) -> np.ndarray:
    """What sorts uint64 ``keys``, equal ones by place. Sorts the keys' upper bits with the place
    in the lower ones, several times as fast as argsort; the rare ties of those are mended after."""
    bits = max(1, len(keys)).bit_length()
    drop = max(0, int(keys.max()).bit_length() + bits - 64) if len(keys) else 0
    mixed = ((keys >> np.uint64(drop)) << np.uint64(bits)) | np.arange(len(keys), dtype=np.uint64)
    mixed.sort()
    order = (mixed & np.uint64((1 << bits) - 1)).astype(np.int64)
    now = keys[order]
    return order if (now[1:] >= now[:-1]).all() else order[np.argsort(now, kind="stable")]


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct values, place of each value among them) of numbers from 0."""
    bits = max(1, len(values)).bit_length()
    if not len(values) or int(values.max()).bit_length() + bits > 64:
        return np.unique(values, return_inverse=True)
    mixed = (values.astype(np.uint64) << np.uint64(bits)) | np.arange(len(values), dtype=np.uint64)
    mixed.sort()
    source = (mixed & np.uint64((1 << bits) - 1)).astype(np.int64)
    mixed >>= np.uint64(bits)
    new = np.concatenate([[True], mixed[1:] != mixed[:-1]])
    place = np.empty(len(values), np.int32)
    place[source] = np.cumsum(new) - 1
    return mixed[new].astype(np.int64), place


def _hashed(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """64-bit keys of pairs of 64-bit keys."""
    with np.errstate(over="ignore"):
        key = one * _A
        key = (key ^ (key >> np.uint64(31))) * _B + two
        key = (key ^ (key >> np.uint64(29))) * _A
        return key ^ (key >> np.uint64(32))


def _by_count(often: np.ndarray) -> np.ndarray:
    """Places from the most frequent word to the least. Texts are stored as ranks, which pack better than places."""
    return np.argsort(-often.astype(np.int64), kind="stable").astype(np.int32)


class Pairs:
    """A block's bigrams in order of their keys: training counts, places of both words; ``at``
    has the place of each token's bigram."""

    def __init__(self, block: Block) -> None:
        n = len(block.words)
        pairs, place = _numbered(block.history.astype(np.int64) * n + block.token)
        one, two = (pairs // n).astype(np.int32), (pairs % n).astype(np.int32)
        key = _hashed(block.words[one], block.words[two])
        order = _order(key)
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        count = _small(np.bincount(place[block.in_train], minlength=len(pairs)))
        self.key, self.count, self.one, self.two, self.at = key[order], count[order], one[order], two[order], back[place]


class Triples:
    """A block's trigrams: training counts, places of the first two words' and of the last two
    words' bigram; ``at`` has the place of each token's trigram, -1 for a text's first token."""

    def __init__(self, block: Block) -> None:
        pairs, inner = block.pairs, np.ones(len(block.token), bool)
        inner[block.ends - block.length] = False
        inner = np.flatnonzero(inner)
        n = len(block.words)
        triples, place = _numbered(pairs.at[inner - 1].astype(np.int64) * n + block.token[inner])
        self.history = (triples // n).astype(np.int32)
        self.lower = np.zeros(len(triples), np.int32)
        self.lower[place] = pairs.at[inner]
        self.count = _small(np.bincount(place[block.in_train[inner]], minlength=len(triples)))
        self.at = np.full(len(block.token), -1, np.int32)
        self.at[inner] = place
        self.pairs = pairs

    def shared(self, total: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted keys, places) of the trigrams that other blocks may have too, from the answers on bigrams."""
        open_ = (total > 0) & (owner != ALONE)
        some = np.flatnonzero(open_[self.history] & open_[self.lower])
        key = _hashed(self.pairs.key[self.history[some]], self.pairs.key[self.lower[some]])
        order = _order(key)
        return key[order], some[order]


class Block:
    """The texts of a block: ids, training flags, lengths, and tokens as places in ``words``."""

    def __init__(self, data: bytes) -> None:
        self.doc, self.null, self.train, self.length, rank, often, self.words = _unpack(data)
        self.token = _by_count(often)[rank]
        self.ends = np.cumsum(self.length)
        starts = self.ends - self.length
        #: Place of each token's history; BEGIN is in every block's words.
        self.history = np.concatenate([[0], self.token[:-1]]).astype(np.int32)
        self.history[starts] = int(np.searchsorted(self.words, BEGIN))
        self.in_train = np.repeat(self.train.astype(bool), self.length)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.token[self.in_train], minlength=len(self.words))

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self)

    @cached_property
    def triples(self) -> Triples:
        return Triples(self)


def _blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        meta: list[tuple] = []
        hashes: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            tokens = np.concatenate(hashes)
            words = np.unique(np.append(tokens, [BEGIN]))
            doc, null, train = (np.array([m[k] for m in meta], t) for k, t in ((0, np.int64), (1, np.uint8), (2, np.uint8)))
            length = np.array([len(h) for h in hashes], np.int64)
            token = np.searchsorted(words, tokens).astype(np.int32)
            often = _small(np.bincount(token, minlength=len(words)))
            rank = np.empty(len(words), np.int32)
            rank[_by_count(often)] = np.arange(len(words), dtype=np.int32)
            return _rows([(part * (1 << 24) + number, 0, "texts", _pack(doc, null, train, length, rank[token], often, words))])

        for batch in batches:
            for doc, held, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                split = (raw.as_py() or b"").lower().split()
                h = np.empty(len(split) + 1, np.uint64)
                h[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, split), np.uint64, len(split))
                h[-1] = END
                meta.append((doc or 0, doc is None, not held))
                hashes.append(h)
                size += len(h)
                if size >= BLOCK_TOKENS:
                    yield closed()
                    meta, hashes, size, number = [], [], 0, number + 1
        if meta:
            yield closed()

    held = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS)) == HELD_FOLD
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(held, F.lit(False)).alias("held"), F.col(text_col).cast("binary").alias("raw"))
    return written(rows.mapInArrow(lean(run), ROW), "lm-blocks")


def _exchange(asked: DataFrame, answers: dict[str, Callable], name: str) -> DataFrame:
    """Written answers of the buckets. ``answers`` has for each kind of rows a function from the
    list of (block, arrays) of a bucket to the rows (block, kind, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = (None, None), []
        for batch in batches:
            for block, b, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (b, kind) != now and held:
                    yield _rows([(k, now[0], out, d) for k, out, d in answers[now[1]](held)])
                    held = []
                now = b, kind
                held.append((block, _unpack(data)))
        if held:
            yield _rows([(k, now[0], out, d) for k, out, d in answers[now[1]](held)])

    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind", "block").mapInArrow(lean(run), ROW), name)


class Sums:
    """The keys of a bucket's blocks, grouped."""

    def __init__(self, held: list) -> None:
        self.held = held
        keys = np.concatenate([a[0] for _, a in held])
        self.order = _order(keys)
        keys = keys[self.order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
        self.starts = np.flatnonzero(new)
        #: Place of each key sent among the distinct ones.
        self.place = np.empty(len(keys), np.int64)
        self.place[self.order] = np.cumsum(new) - 1

    def first(self, column: int) -> np.ndarray:
        """A column that is the same in all blocks, by distinct key."""
        return np.concatenate([a[column] for _, a in self.held])[self.order[self.starts]].astype(np.int64)

    def of(self, column: int) -> np.ndarray:
        """Totals of a column by distinct key."""
        values = np.concatenate([a[column] for _, a in self.held])[self.order]
        return np.add.reduceat(values if values.dtype.kind == "f" else values.astype(np.int64), self.starts)

    def owners(self) -> np.ndarray:
        """For each key sent: FIRST where the block is the first to hold it, ALONE where no other does, else 0."""
        owner = np.zeros(len(self.place), np.uint8)
        held_by = np.diff(np.append(self.starts, len(self.place)))
        owner[self.order[self.starts]] = np.where(held_by == 1, ALONE, FIRST)
        return owner

    def blocks(self) -> Iterator[tuple]:
        """(block, its arrays, the range of its keys among those sent)."""
        at = 0
        for block, arrays in self.held:
            yield block, arrays, slice(at, at := at + len(arrays[0]))


def _statistics(total: np.ndarray) -> np.ndarray:
    """n_1 to n_k+1, distinct keys and tokens in training."""
    return np.array([int((total == c).sum()) for c in range(1, KATZ_K + 2)] + [int((total > 0).sum()), int(total.sum())], np.int64)


def _count_answer(kind: str, numbered: bool = True) -> Callable:
    """To each block the totals of its keys, whether it holds the key first or alone, and, in rows
    of their own, the numbers in the bucket of those that it doesn't hold alone; and statistics."""

    def answer(held: list) -> Iterator[tuple]:
        sums = Sums(held)
        total = sums.of(1)
        owners = sums.owners()
        for block, _, mine in sums.blocks():
            place, owner = sums.place[mine], owners[mine]
            yield block, kind, _pack(_small(total[place]), owner)
            if numbered:
                yield block, f"{kind}_numbers", _pack(place[owner != ALONE].astype(np.uint64))
        yield -1, "stats", _statistics(total).tobytes()

    return answer


def _local_answer(held: list) -> Iterator[tuple]:
    """Statistics of what blocks have counted themselves."""
    yield -1, "stats", sum(a[0] for _, a in held).astype(np.int64).tobytes()


def _stats(table: DataFrame) -> list[int]:
    """Sums over the buckets of n_1 to n_k+1, distinct keys and tokens in training."""
    width = KATZ_K + 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                total += np.frombuffer(data, "<i8")
        yield pa.RecordBatch.from_arrays([pa.array([int(v)], pa.int64()) for v in total], names=[f"s{k}" for k in range(width)])

    part = table.where("kind = 'stats'").select("data").mapInArrow(lean(run), ", ".join(f"s{k} bigint" for k in range(width)))
    row = part.agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0)) for k in range(width)]).first()
    return list(row)


def discounts(n: list[int]) -> np.ndarray:
    """Good-Turing ratios d[c] for counts 0..KATZ_K+1 (the last stands for all larger) from n_1.."""
    d = np.ones(KATZ_K + 2)
    common = (KATZ_K + 1) * n[KATZ_K] / n[0] if n[0] else 1.0
    for c in range(1, KATZ_K + 1):
        if n[c - 1] and n[c] and common < 1:
            r = ((c + 1) * n[c] / (c * n[c - 1]) - common) / (1 - common)
            if 0 < r < 1:
                d[c] = r
    if d[1] == 1 and n[0]:
        d[1] = (n[0] + 1) / (n[0] + 2 * n[1] + 2)
    return d


class Model:
    """The driver's few numbers: discounts by order and totals."""

    def __init__(self, words: list[int], *longer: list[int]) -> None:
        self.types, self.tokens = words[KATZ_K + 1], words[KATZ_K + 2]
        self.word_d = discounts(words)
        #: Discounts of bigrams, trigrams.
        self.ratio = [discounts(n) for n in longer]
        seen = self.tokens - sum((1 - self.word_d[c]) * c * words[c - 1] for c in range(1, KATZ_K + 1))
        self.scale = 1.0
        self.unknown = 1 - seen / self.tokens if self.tokens else 1.0
        if self.unknown <= 1e-12:  # nothing was discounted
            self.unknown = 1 / (self.tokens + 1)
            self.scale = 1 - self.unknown

    def word(self, count: np.ndarray) -> np.ndarray:
        """Unigram probability; of the unknown class for a count of 0."""
        count = count.astype(np.int64)
        known = self.word_d[np.minimum(count, KATZ_K + 1)] * count / max(1, self.tokens) * self.scale
        return np.where(count > 0, known, self.unknown)

    def discounted(self, count: np.ndarray, order: int = 2) -> np.ndarray:
        count = count.astype(np.int64)
        return self.ratio[order - 2][np.minimum(count, KATZ_K + 1)] * count

    def given(self, order: int, count: np.ndarray, uses: np.ndarray, weight: np.ndarray, scale: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probability of n-grams: discounted if seen, else by the history's weight from the lower order's."""
        return np.where(count > 0, scale * self.discounted(count, order) / np.maximum(uses, 1), weight * lower)


def _rare(history: np.ndarray, total: np.ndarray, n: int) -> list[np.ndarray]:
    """How many of each history's n-grams occur 1, 2, ... KATZ_K times."""
    return [_small(np.bincount(history[total == c], minlength=n)) for c in range(1, KATZ_K + 1)]


def _freed(rare: list[np.ndarray], discount: np.ndarray) -> np.ndarray:
    """What discounting frees: the sum of (1 - d[c]) c over the n-grams of each history."""
    return sum(float((1 - discount[c]) * c) * rare[c - 1].astype(np.float64) for c in range(1, KATZ_K + 1))


def _backoff(uses: np.ndarray, lower: np.ndarray, rare: list[np.ndarray], discount: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weight and scale of each history from its uses, the lower-order mass of its n-grams
    and how many of them occur 1, 2, ... KATZ_K times."""
    used = uses > 0
    free = np.where(used, _freed(rare, discount) / np.maximum(uses, 1), 1.0)
    bare = used & (free <= BARE)  # all its counts are too large to be discounted
    free = np.where(bare, 1 / (uses + 1.0), free)
    return np.where(used, free / np.maximum(1 - lower, 1e-300), 1.0), np.where(bare, 1 - free, 1.0)


def _backoff_answer(kind: str, discount: np.ndarray) -> Callable:
    """To each block the weights and scales of the histories that it needs, from sums over the blocks."""

    def answer(held: list) -> Iterator[tuple]:
        sums = Sums(held)
        weight, scale = _backoff(sums.first(1), sums.of(3), [sums.of(3 + c) for c in range(1, KATZ_K + 1)], discount)
        for block, arrays, mine in sums.blocks():
            needed = sums.place[mine][arrays[2] > 0]
            yield block, kind, _pack(weight[needed], scale[needed])

    return answer


class Histories:
    """A block's histories of one length: what it adds to their sums, and whose weights it needs."""

    def __init__(self, history: np.ndarray, total: np.ndarray, own: np.ndarray, lower: np.ndarray, uses: np.ndarray, owner: np.ndarray, discount: np.ndarray) -> None:
        """For each n-gram its history, total, whether this block answers for it, and its lower-order
        probability; for each history its uses and whether the block holds it first or alone."""
        n = len(uses)
        self.uses, self.discount = uses, discount
        self.lower = np.bincount(history[own], weights=lower[own], minlength=n)
        self.rare = _rare(history[own], total[own], n)
        unseen = np.bincount(history[total == 0], minlength=n) > 0
        # One n-gram here that frees enough proves that its history isn't bare.
        perhaps_bare = (np.bincount(history, minlength=n) > 0) & (_freed(_rare(history, total, n), discount) <= 10 * BARE * uses)
        need = (unseen | perhaps_bare) & (uses > 0)
        #: Histories that other blocks have too; of these, whether they are sent, and whether needed.
        self.open = np.flatnonzero(owner != ALONE)
        self.need = need[self.open]
        self.send = self.need | (np.bincount(history[own], minlength=n) > 0)[self.open]

    def columns(self) -> list[np.ndarray]:
        """What is sent, beside the histories' numbers."""
        some = self.open[self.send]
        return [_small(self.uses[some]), self.need[self.send].astype(np.uint8), self.lower[some], *[r[some] for r in self.rare]]

    def weights(self, weight: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight and scale of each history: answered if needed and open, else by the block's own sums."""
        weights, scales = _backoff(self.uses, self.lower, self.rare, self.discount)
        weights[self.open] = scales[self.open] = 1.0  # where neither is needed, no n-gram is scored by them
        weights[self.open[self.need]], scales[self.open[self.need]] = weight, scale
        return weights, scales


def _by_block(tables: list[DataFrame], parts: int, numbers: str = "") -> DataFrame:
    """All rows of a block together: its texts first, then the answers by bucket. Numbers only of the kind named."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    wanted = (F.col("block") >= 0) & (~F.col("kind").endswith("_numbers") | (F.col("kind") == f"{numbers}_numbers"))
    return union.where(wanted).repartition(parts, "block").sortWithinPartitions("block", F.col("kind") != "texts", "kind", "bucket")


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, list[bytes]]]]:
    block, held = None, {}
    for batch in batches:
        for b, _, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block and held:
                yield block, held
                held = {}
            block = b
            held.setdefault(kind, []).append(data)
    if held:
        yield block, held


class Answers:
    """A block with what the buckets have answered."""

    def __init__(self, held: dict[str, list[bytes]], model: Model) -> None:
        self.block, self.model = Block(held["texts"][0]), model
        self.held = {kind: [_unpack(p) for p in parts] for kind, parts in held.items() if kind != "texts"}
        held.clear()
        self.count = self.column("words", 0).astype(np.int64)
        self.chance = model.word(self.count)
        self.total, self.owner = self.column("pairs", 0).astype(np.int64), self.column("pairs", 1)

    def column(self, kind: str, k: int) -> np.ndarray:
        """One column of a kind of answers; it can be read once."""
        if kind not in self.held:
            return np.zeros(0, np.uint8)
        out = np.concatenate([p[k] for p in self.held[kind]])
        for p in self.held[kind]:
            p[k] = None
        return out

    @cached_property
    def words(self) -> Histories:
        pairs, words = self.block.pairs, self.block.words
        uses = self.count.copy()
        uses[np.searchsorted(words, BEGIN)] = self.count[np.searchsorted(words, END)]  # a start for each end
        own = (self.owner > 0) & (self.total > 0)
        return Histories(pairs.one, self.total, own, self.chance[pairs.two], uses, self.column("words", 1), self.model.ratio[0])

    @cached_property
    def pair_chance(self) -> np.ndarray:
        """Probability of each bigram's word after its history."""
        pairs, words = self.block.pairs, self.words
        weight, scale = words.weights(self.column("weights", 0), self.column("weights", 1))
        return self.model.given(2, self.total, words.uses[pairs.one], weight[pairs.one], scale[pairs.one], self.chance[pairs.two])

    @cached_property
    def triple_totals(self) -> tuple[np.ndarray, np.ndarray]:
        """Training count of each trigram over all blocks, and whether this block answers for it."""
        triples = self.block.triples
        total, own = triples.count.astype(np.int64), np.ones(len(triples.count), bool)
        _, some = triples.shared(self.total, self.owner)
        total[some], own[some] = self.column("triples", 0), self.column("triples", 1) > 0
        return total, own & (total > 0)

    @cached_property
    def pairs(self) -> Histories:
        """Bigrams as histories; each use of one is an occurrence."""
        triples = self.block.triples
        return Histories(triples.history, *self.triple_totals, self.pair_chance[triples.lower], self.total, self.owner, self.model.ratio[1])

    def token_chance(self, order: int) -> np.ndarray:
        at, chance = self.block.pairs.at, self.pair_chance
        if order == 2:
            return chance[at]
        t = self.block.triples
        weight, scale = self.pairs.weights(self.column("pair_weights", 0), self.column("pair_weights", 1))
        longer = self.model.given(3, self.triple_totals[0], self.total[t.history], weight[t.history], scale[t.history], chance[t.lower])
        return np.where(t.at >= 0, np.append(longer, 0.0)[t.at], chance[at])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``order`` is the longest n-gram: 2 or 3.
    """
    if order not in (2, 3):
        raise ValueError(f"the order must be 2 or 3, not {order}")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(docs, id_col, text_col)
    # A task holds one bucket at a time, so buckets follow the number of blocks, not the number of partitions.
    buckets = max(parts, -(-blocks.count() // BUCKET_BLOCKS))

    def sliced(block: int, kind: str, keys: np.ndarray, *columns: np.ndarray) -> list[tuple]:
        at = _bounds(keys, buckets)
        return [(block, k, kind, _pack(*[c[at[k] : at[k + 1]] for c in columns])) for k in range(buckets) if at[k + 1] > at[k]]

    def asked(block: int, kind: str, keys: np.ndarray, numbers: np.ndarray, histories: Histories) -> list[tuple]:
        return sliced(block, kind, keys[histories.open[histories.send]], numbers[histories.send], *histories.columns())

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _each_block(batches):
            b = Block(held["texts"][0])
            yield _rows(sliced(block, "words", b.words, b.words, _small(b.word_counts())))

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held in _each_block(batches):
            pairs = Block(held["texts"][0]).pairs
            yield _rows(sliced(block, "pairs", pairs.key, pairs.key, _small(pairs.count)))

    words = _exchange(blocks.mapInArrow(lean(ask_words), ROW), {"words": _count_answer("words")}, "lm-words")
    pairs = _exchange(blocks.mapInArrow(lean(ask_pairs), ROW), {"pairs": _count_answer("pairs")}, "lm-bigrams")
    model = Model(_stats(words), _stats(pairs))

    def ask_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of words as histories, and counts of trigrams."""
        for block, held in _each_block(batches):
            a = Answers(held, model)
            b = a.block
            yield _rows(asked(block, "weights", b.words, a.column("words_numbers", 0), a.words))
            if order == 3:
                keys, some = b.triples.shared(a.total, a.owner)
                yield _rows(sliced(block, "triples", keys, keys, _small(b.triples.count[some])))
                local = np.ones(len(b.triples.count), bool)
                local[some] = False
                yield _rows([(block, block % buckets, "local", _pack(_statistics(b.triples.count[local])))])
                del keys, some, local
            del a, b  # before the next block comes

    answers = {"weights": _backoff_answer("weights", model.ratio[0]), "triples": _count_answer("triples", numbered=False), "local": _local_answer}
    tables = [blocks, words, pairs]
    tables.append(_exchange(_by_block(tables, parts, "words").mapInArrow(lean(ask_more), ROW), answers, "lm-trigrams"))
    if order == 3:
        model.ratio.append(discounts(_stats(tables[-1])))

        def ask_pair_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, held in _each_block(batches):
                a = Answers(held, model)
                yield _rows(asked(block, "pair_weights", a.block.pairs.key, a.column("pairs_numbers", 0), a.pairs))
                del a  # before the next block comes

        sums = _by_block(tables, parts, "pairs").mapInArrow(lean(ask_pair_weights), ROW)
        tables.append(_exchange(sums, {"pair_weights": _backoff_answer("pair_weights", model.ratio[1])}, "lm-weights"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in _each_block(batches):
            a = Answers(held, model)
            b, count = a.block, a.count
            log = np.log10(a.token_chance(order))
            base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.types + 1)))
            starts = b.ends - b.length
            known = np.add.reduceat((count > 0)[b.token].astype(np.int64), starts)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(b.doc, pa.int64(), mask=b.null.astype(bool)), "held_out": pa.array(~b.train.astype(bool)),
                "n_tokens": pa.array(b.length, pa.int64()), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(b.doc), model.tokens), pa.int64()),
                "base_score": pa.array(np.add.reduceat(base[b.token], starts)), "score": pa.array(np.add.reduceat(log, starts)),
            })
            del a, b, count, log, base, starts, known  # before the next block comes

    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return _by_block(tables, parts).mapInArrow(lean(judge), out)
