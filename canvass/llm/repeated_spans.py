"""Removal of every byte covered by a long byte string that also starts elsewhere.

The order of suffixes is needed only where a string of ``length`` bytes occurs twice. So suffixes
are dealt into buckets, only buckets that may hold two equal strings are kept, and these are sorted
a block of buckets at a time, with a difference cover (``suffixes``):

1. Buckets. Each string of ``length`` bytes chooses the position inside it whose ``GRAM`` bytes have
   the least hash (the last one on ties). The choice depends on the string's bytes alone, so equal
   strings choose equal grams, at the same distance. A bucket has the strings that chose one gram.
   A pass over the texts writes the chosen positions (about one in 170); grams chosen at one place
   only are dropped. Equal surroundings of a gram are one, with a mark; the bytes of one of each are
   fetched.
2. Sorting. A task takes blocks of whole buckets. In a block the samples of a periodic difference
   cover are ranked, suffixes are sorted by their first bytes, and long ties are resolved by the
   ranks of samples. Strings are equal where all their bytes are; no hash decides.
3. Buckets of more than ``hot`` different surroundings, such as those inside a passage that very many
   texts share, would not fit a block: their strings are counted one by one under a 128-bit hash,
   with partial sums before the shuffle.

Texts are known by a 128-bit hash, so copies cost one; they are removed whole where they are long
enough. Defined cases: null text is empty; rows that repeat an id are rows of their own; texts
shorter than ``length`` stay; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import discard, fresh, written
from .suffixes import repeated_starts
from .workers import lean

LENGTH = 400
GRAM = 64
#: Long texts are read in pieces of so many string starts; at most 2**20.
PIECE = 1 << 19
#: Different surroundings in a bucket that is sorted in a block.
HOT = 4000
#: A block is closed beyond so many bytes.
BLOCK_BYTES = 2_000_000

_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)
_B, _C = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_ODD))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        with np.errstate(over="ignore"):
            up, down = np.full(size, _ODD, np.uint64), np.full(size, _INVERSE, np.uint64)
            up[0] = down[0] = 1
            _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of all ``width`` bytes of a uint8 array; equal bytes, equal hash."""
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * down[: len(data)], out=total[1:])
        return _mix((total[width:] - total[: len(data) + 1 - width]) * up[: len(data) + 1 - width])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def choices(raw: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By piece: (gram hash, its position, first and last start of the strings that chose it)."""
    gram = min(GRAM, length)
    mask = np.uint64((1 << 20) - 1)
    for at in range(0, max(0, len(raw) - length + 1), PIECE):
        data = np.frombuffer(raw, np.uint8, min(PIECE + length - 1, len(raw) - at), at)
        h = rolling(data, gram)
        ranked = (h & ~mask) | (mask - np.arange(len(h), dtype=np.uint64))
        least = _sliding_min(ranked, length - gram + 1)
        place = (mask - (least & mask)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        chosen = place[first]
        yield h[chosen], chosen + at, first + at, last + at


def runs_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of each run of true values."""
    edge = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1).tolist(), (np.flatnonzero(edge == -1) - 1).tolist(), strict=True))


def block_repeats(rows: list[bytes], length: int) -> list[np.ndarray]:
    """For each of the rows of a block, which of its string starts occur twice or more in the block."""
    data = np.frombuffer(b"".join(rows), np.uint8)
    ends = np.cumsum([len(r) for r in rows])
    sizes = np.array([len(r) - length + 1 for r in rows])
    starts = np.repeat(ends - np.array([len(r) for r in rows]) - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    return np.split(repeated_starts(data, starts, length), np.cumsum(sizes)[:-1])


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _columns(rows: list[tuple], kinds: list[pa.DataType], names: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names.split())


_LONG, _INT = pa.int64(), pa.int32()
#: A surrounding: its gram, its bytes by hash, and how far the gram is from its first byte.
AROUND = ["gram", "a1", "a2", "distance"]


def _key(raw: Column) -> tuple[Column, Column]:
    """A 128-bit hash of a text."""
    return F.xxhash64(F.lit(1), raw).alias("k1"), F.xxhash64(F.lit(2), raw).alias("k2")


def repeated_spans(texts: DataFrame, length: int, hot: int) -> DataFrame:
    """(k1, k2, spans): for texts (k1, k2, raw) of at least ``length`` bytes, by key, the byte spans
    [a, b) to remove, which may overlap."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[int, int]] = set()
        for batch in batches:
            rows = []
            for key, x in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2), strict=True):
                if key in met:
                    continue
                met.add(key)
                text = x.as_py()
                for h, place, first, last in choices(text, length):
                    for g, p, a, b in zip(h.view(np.int64).tolist(), place.tolist(), first.tolist(), last.tolist(), strict=True):
                        around = xxhash.xxh3_128_intdigest(text[a : b + length])
                        rows.append((*key, g, p, a, b, (around >> 64) - (1 << 63), (around & (1 << 64) - 1) - (1 << 63)))
            if len(met) > 100_000:
                met.clear()
            yield _columns(rows, [_LONG, _LONG, _LONG, _INT, _INT, _INT, _LONG, _LONG], "k1 k2 gram place first last a1 a2")

    anchors = written(texts.mapInArrow(lean(choose), "k1 bigint, k2 bigint, gram bigint, place int, first int, last int, a1 bigint, a2 bigint"), "anchors")
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("k1", "k2", "place") for f in (F.min, F.max)]
    again = anchors.groupBy("gram").agg(*ends).where("min_k1 <> max_k1 or min_k2 <> max_k2 or min_place <> max_place").select("gram")
    again = written(again, "repeated-grams")
    suspects = written(anchors.join(again, "gram").select("gram", "a1", "a2", (F.col("place") - F.col("first")).alias("distance"), "k1", "k2", "first", "last"), "suspects")
    discard(anchors, again)
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("k1", "k2", "first") for f in (F.min, F.max)]
    around = suspects.groupBy(*AROUND).agg(*ends, F.min(F.struct("k1", "k2", "first", "last")).alias("one"))
    around = written(around.select(*AROUND, F.expr("min_k1 <> max_k1 or min_k2 <> max_k2 or min_first <> max_first").alias("many"), "one.*"), "surroundings")
    groups = written(around.groupBy("gram").agg(F.count("*").alias("size"), F.max("many").alias("any")).where("size > 1 or any").select("gram", "size"), "buckets")
    live = around.join(groups, "gram")
    wanted = live.groupBy("k1", "k2").agg(F.collect_list(F.struct(*AROUND, "many", "size", "first", "last")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, names = [_LONG, _LONG, _LONG, _INT, pa.bool_(), _LONG, pa.binary()], "gram a1 a2 distance many size data"
        for batch in batches:
            rows, held = [], 0
            for x, wants in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                text = x.as_py()
                for w in wants:
                    rows.append((*(w[c] for c in AROUND), w["many"], w["size"], text[w["first"] : w["last"] + length]))
                    held += len(rows[-1][-1])
                    if held > 4_000_000:
                        yield _columns(rows, kinds, names)
                        rows, held = [], 0
            yield _columns(rows, kinds, names)

    one_each = texts.groupBy("k1", "k2").agg(F.first("raw").alias("raw"))
    fetched = one_each.join(wanted, ["k1", "k2"]).select("raw", "wanted").mapInArrow(lean(fetch), "gram bigint, a1 bigint, a2 bigint, distance int, many boolean, size bigint, data binary")
    fetched = written(fetched, "bucket-bytes")
    discard(around, groups)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, size, gram = [], [], 0, None

        def done() -> pa.RecordBatch:
            out = []
            for (*key, many), hit in zip(keys, block_repeats(rows, length), strict=True):
                if runs := [(0, len(hit) - 1)] if many else runs_of(hit):
                    out.append((*key, [{"a": a, "b": b} for a, b in runs]))
            return _columns(out, [_LONG, _LONG, _LONG, _INT, pa.list_(pa.struct([("a", _INT), ("b", _INT)]))], "gram a1 a2 distance runs")

        for batch in batches:
            for *key, many, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key[0] != gram and size > BLOCK_BYTES:
                    yield done()
                    keys, rows, size = [], [], 0
                gram = key[0]
                keys.append((*key, many))
                rows.append(data)
                size += len(data)
        if rows:
            yield done()

    usual = fetched.where(F.col("size") <= hot).select(*AROUND, "many", "data").repartition(parts, "gram").sortWithinPartitions("gram")
    runs_schema = "gram bigint, a1 bigint, a2 bigint, distance int, runs array<struct<a:int,b:int>>"
    runs = usual.mapInArrow(lean(sort), runs_schema)

    def by_string(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, a1, a2, d, many, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(data) - length + 1
                found = [xxhash.xxh3_128_intdigest(data[k : k + length]) for k in range(n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * n, k) for v, k in ((g, _LONG), (a1, _LONG), (a2, _LONG), (d, _INT), (2 if many else 1, _INT))]
                    + [pa.array(range(n), _INT), pa.array([(f >> 64) - (1 << 63) for f in found], _LONG), pa.array([(f & (1 << 64) - 1) - (1 << 63) for f in found], _LONG)],
                    names=[*AROUND, "uses", "a", "s1", "s2"],
                )

    hot_rows = fetched.where(F.col("size") > hot).select(*AROUND, "many", "data")
    strings = written(hot_rows.mapInArrow(lean(by_string), "gram bigint, a1 bigint, a2 bigint, distance int, uses int, a int, s1 bigint, s2 bigint"), "hot-strings")
    common = written(strings.groupBy("s1", "s2").agg(F.sum("uses").alias("n")).where("n > 1").select("s1", "s2"), "hot-repeats")
    found = strings.join(common, ["s1", "s2"]).groupBy(*AROUND).agg(F.collect_list(F.struct("a", F.col("a").alias("b"))).alias("runs"))
    # A row for each surrounding, written, so that the join can split those that many texts share.
    runs = written(runs.unionByName(found), "runs")
    placed = F.transform("runs", lambda r: F.struct((F.col("first") + r["a"]).alias("a"), (F.col("first") + r["b"] + length).alias("b")))
    spans = suspects.join(runs, AROUND).select("k1", "k2", placed.alias("spans"))
    copies = texts.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max(F.length("raw")).alias("b")).where("n > 1")
    spans = spans.unionByName(copies.select("k1", "k2", F.array(F.struct(F.lit(0).alias("a"), "b")).alias("spans")))
    out = written(spans.groupBy("k1", "k2").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    discard(suspects, fetched, strings, common, runs)
    return out


def remove_repeats(docs: DataFrame, text_col: str = "text", length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``docs`` plus n_bytes, n_removed, n_spans (bigint), spans (array of [start, end) in bytes)
    and kept (binary: the bytes that stay, which may cut a character). Added names that docs has
    already get a trailing underscore."""
    names = docs.columns
    raw = F.col(text_col).cast("binary")
    long = docs.where(F.length(raw) >= length)
    found = repeated_spans(long.select(*_key(raw), raw.alias("raw")), length, hot)
    added: list[str] = []
    for c in ("n_bytes", "n_removed", "n_spans", "spans", "kept"):
        added.append(fresh([*names, *added], c))
    span_type = T.ArrayType(T.ArrayType(T.LongType()))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(added, [T.LongType()] * 3 + [span_type, T.BinaryType()], strict=True)]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[tuple[int, int, int]] = []
            removed, kept = [], []
            for x, value in zip(batch.column(len(names)), batch.column(len(names) + 1).to_pylist(), strict=True):
                t, spans = x.as_py() or b"", _merged([(s["a"], s["b"]) for s in value or ()])
                ends = [0, *[y for s in spans for y in s], len(t)]
                kept.append(b"".join(t[ends[k] : ends[k + 1]] for k in range(0, len(ends), 2)))
                removed.append([list(s) for s in spans])
                counts.append((len(t), len(t) - len(kept[-1]), len(spans)))
            cols = [pa.array([c[k] for c in counts], _LONG) for k in range(3)] + [pa.array(removed, pa.list_(pa.list_(_LONG))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *cols], names=[*names, *added])

    own = [F.col(f"`{c}`") for c in names]
    k1, k2, raw_col, span_col = (fresh([*names, *added], c) for c in ("text_k1", "text_k2", "raw_bytes", "found_spans"))
    keyed = long.select(*own, *[k.alias(c) for k, c in zip(_key(raw), (k1, k2), strict=True)])
    known = found.select(F.col("k1").alias("found_k1"), F.col("k2").alias("found_k2"), F.col("spans").alias(span_col))
    joined = keyed.join(known, (keyed[k1] == known["found_k1"]) & (keyed[k2] == known["found_k2"]), "left").select(*own, raw.alias(raw_col), span_col)
    short = docs.where(F.coalesce(F.length(raw) < length, F.lit(True))).select(*own, raw.alias(raw_col), F.lit(None).cast(found.schema["spans"].dataType).alias(span_col))
    return joined.mapInArrow(lean(cut), schema).unionByName(short.mapInArrow(lean(cut), schema))


def digest(docs: DataFrame) -> DataFrame:
    """The op8 result."""
    cut = remove_repeats(docs.select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
