"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned onto their leading principal axes and sorted by label and by grid cell
of width epsilon on those axes (cosine >= c means a distance of at most sqrt(2 - 2c)). The
sequence is cut into blocks. Blocks meet by buckets of the first two axes, and block pairs whose
boxes are further apart than epsilon are never joined; the others are split recursively in the same way and only short intervals are compared,
exactly, in double precision. Equal vectors of a label are one class with a weight, so large
groups of copies cost one vector, and a block pair returns counts and a spanning forest of its
links, never the links themselves.

The axes are fitted on at most SAMPLE classes (those of least hash); they steer only what is
skipped, and skipping is proven for any axes.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, and those
with a null label or id, link with nothing; very large and very small components are scaled before
they are squared; vectors of different lengths don't link; rows that repeat an id are separate
vectors; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Groups, components
from .storage import written
from .workers import lean

THRESHOLD = 0.98
AXES = 8
SORTED_AXES = 4
BLOCK = 1024
LEAF = 64
SAMPLE = 4096


def _basis(sample: list, axes: int) -> dict[int, np.ndarray]:
    """Principal axes (columns) for each vector length met in the sample."""
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r.vector), []).append(r.vector)
    out = {}
    for dim, rows in by.items():
        x = _unit(np.array(rows))
        out[dim] = np.linalg.eigh(np.cov(x.T).reshape(dim, dim) if len(x) > 1 else np.eye(dim))[1][:, ::-1][:, :axes]
    return out


def _axes_of(basis: dict[int, np.ndarray], dim: int, axes: int) -> np.ndarray:
    found = basis.get(dim)
    return np.eye(dim)[:, :axes] if found is None else found


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of unit length, in double precision; scaled by a power of two first, as squares of very large or small numbers have no double."""
    x = x.astype(np.float64)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrices(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for the vectors of each length in a list column without nulls."""
    length = vectors.value_lengths().to_numpy()
    flat, ends = vectors.flatten().to_numpy(), np.cumsum(length)
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        yield at, flat[(ends[at] - n)[:, None] + np.arange(n)]


class _Join:
    """Recursive join of two sorted sequences of unit vectors."""

    def __init__(self, a: np.ndarray, b: np.ndarray, axes: np.ndarray, same: bool, cosine: float, epsilon: float) -> None:
        self.a, self.b, self.pa, self.pb = a, b, a @ axes, b @ axes
        self.same, self.cosine, self.reach = same, cosine, epsilon**2 * (1 + 1e-9) + 1e-12
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def run(self, i0: int, i1: int, j0: int, j1: int) -> None:
        if self.same and j1 <= i0 + 1 and i0 >= j0:
            return
        low_a, high_a = self.pa[i0:i1].min(0), self.pa[i0:i1].max(0)
        low_b, high_b = self.pb[j0:j1].min(0), self.pb[j0:j1].max(0)
        gap = np.maximum(0, np.maximum(low_a - high_b, low_b - high_a))
        if gap @ gap > self.reach:
            return
        if i1 - i0 <= LEAF and j1 - j0 <= LEAF:
            i, j = np.nonzero(self.a[i0:i1] @ self.b[j0:j1].T >= self.cosine)
            i, j = i + i0, j + j0
            keep = i < j if self.same else slice(None)
            self.found.append((i[keep], j[keep]))
        elif i1 - i0 >= j1 - j0:
            m = (i0 + i1) // 2
            self.run(i0, m, j0, j1)
            self.run(m, i1, j0, j1)
        else:
            m = (j0 + j1) // 2
            self.run(i0, i1, j0, m)
            self.run(i0, i1, m, j1)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    epsilon = math.sqrt(max(0.0, 2 - 2 * threshold))
    # Vectors of floats stay floats until they are compared.
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    dtype = np.dtype("<f4" if kind == "float" else "<f8")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.size("vector") > 0, F.lit(False))
        & ~F.coalesce(F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
        & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    )
    rows = rows.withColumn("sound", sound)
    # Signed zeros are one value.
    good = rows.where("sound").withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0).cast(kind)))
    # Equal vectors of a label are a class, known by a 128-bit hash and, from then on, by a number.
    keys = ["label", "k1", "k2"]
    good = good.select("vec_id", "label", "vector", F.xxhash64(F.lit(1), "vector").alias("k1"), F.xxhash64(F.lit(2), "vector").alias("k2"))
    classes = good.groupBy(*keys).agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vector").alias("vector"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    basis = _basis(classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("vector").collect(), AXES)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros((batch.num_rows, SORTED_AXES), np.int64)
            for at, x in _matrices(batch.column("vector")):
                p = (_unit(x) @ _axes_of(basis, x.shape[1], AXES))[:, :SORTED_AXES]
                cells[at, : p.shape[1]] = np.floor(p / epsilon) if epsilon else 0
            cols = [batch.column(c) for c in ("label", "vector", "class", "weight")]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(cells[:, k]) for k in range(SORTED_AXES)]], names=["label", "vector", "class", "weight", *[f"c{k}" for k in range(SORTED_AXES)]])

    cell_cols = [f"c{k}" for k in range(SORTED_AXES)]
    order = [F.col("label"), F.size("vector"), *cell_cols, F.col("class")]
    dealt = classes.mapInArrow(lean(celled), f"label string, vector array<{kind}>, class bigint, weight bigint, " + ", ".join(f"{c} bigint" for c in cell_cols)).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # runs of one label and length: (label, matrix, classes, weights)
        size = 0

        def block() -> pa.RecordBatch:
            nonlocal number
            x, found, weights = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            p = _unit(x) @ _axes_of(basis, x.shape[1], AXES)
            number += 1
            return pa.RecordBatch.from_pydict({
                "block": pa.array([part * (1 << 32) + number], pa.int64()), "label": [held[0][0]], "dim": pa.array([x.shape[1]], pa.int32()),
                "low": pa.array([p.min(0).tolist()], pa.list_(pa.float64())), "high": pa.array([p.max(0).tolist()], pa.list_(pa.float64())),
                "classes": pa.array([found.tolist()], pa.list_(pa.int64())), "weights": pa.array([weights.tolist()], pa.list_(pa.int64())), "data": pa.array([x.astype(dtype).tobytes()], pa.binary()),
            })

        for batch in batches:
            labels, length = batch.column("label").to_pylist(), batch.column("vector").value_lengths().to_numpy()
            numbers, weights = batch.column("class").to_numpy(), batch.column("weight").to_numpy()
            flat, ends = batch.column("vector").flatten().to_numpy(), np.cumsum(length)
            at = 0
            while at < len(labels):
                end = at + 1
                room = BLOCK - size if held and (held[0][0], held[0][1].shape[1]) == (labels[at], length[at]) else BLOCK
                while end < len(labels) and end - at < room and labels[end] == labels[at] and length[end] == length[at]:
                    end += 1
                if held and (size >= BLOCK or (held[0][0], held[0][1].shape[1]) != (labels[at], length[at])):
                    yield block()
                    held, size = [], 0
                    continue
                held.append((labels[at], flat[ends[at] - length[at] : ends[end - 1]].reshape(end - at, int(length[at])), numbers[at:end], weights[at:end]))
                size += end - at
                at = end
        if held:
            yield block()

    blocks = written(dealt.mapInArrow(lean(cut), "block bigint, label string, dim int, low array<double>, high array<double>, classes array<bigint>, weights array<bigint>, data binary"), "vector-blocks")
    # Intervals on the first two axes, widened by epsilon, meet in at least one bucket (coordinates of unit vectors span
    # 2 / epsilon buckets at most); a pair counts in the last of their first ones.
    width = max(epsilon, 1e-3)
    spread = blocks.select("block", "label", "dim", "low", "high")
    for k in (0, 1):
        low, high = (F.coalesce(F.get(c, F.lit(k)), F.lit(0.0)) for c in ("low", "high"))
        spread = spread.withColumns({f"first{k}": F.floor(low / width), f"last{k}": F.floor((high + width) / width)})
        spread = spread.withColumn(f"bucket{k}", F.explode(F.sequence(f"first{k}", f"last{k}"))).drop(f"last{k}")
    met = ["label", "dim", "bucket0", "bucket1"]
    a, b = (spread.select([F.col(c).alias(c if c in met else f"{c}_{s}") for c in spread.columns]) for s in "ab")
    gap = F.aggregate(
        F.zip_with(F.zip_with("low_a", "high_b", lambda x, y: x - y), F.zip_with("low_b", "high_a", lambda x, y: x - y), lambda x, y: F.pow(F.greatest(x, y, F.lit(0.0)), F.lit(2.0))),
        F.lit(0.0), lambda s, x: s + x,
    )
    once = (F.col("bucket0") == F.greatest("first0_a", "first0_b")) & (F.col("bucket1") == F.greatest("first1_a", "first1_b"))
    near = a.join(b, met).where((F.col("block_a") <= F.col("block_b")) & once & (gap <= epsilon**2 * (1 + 1e-9) + 1e-12))
    pairs = near.select("block_a", "block_b").repartition(parts * 2, "block_a", "block_b")
    left = blocks.select(F.col("block").alias("block_a"), "dim", F.col("classes").alias("classes_a"), F.col("weights").alias("weights_a"), F.col("data").alias("data_a"))
    right = blocks.select(F.col("block").alias("block_b"), F.col("classes").alias("classes_b"), F.col("weights").alias("weights_b"), F.col("data").alias("data_b"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                same = r["block_a"] == r["block_b"]
                ua, ub = (_unit(np.frombuffer(r[c], dtype).reshape(-1, r["dim"])) for c in ("data_a", "data_b"))
                task = _Join(ua, ub, _axes_of(basis, r["dim"], AXES), same, threshold, epsilon)
                task.run(0, len(ua), 0, len(ub))
                if not sum(len(i) for i, _ in task.found):
                    continue
                i, j = (np.concatenate([f[n] for f in task.found]) for n in (0, 1))
                wa, wb = np.array(r["weights_a"]), np.array(r["weights_b"])
                na, nb = np.zeros(len(ua), np.int64), np.zeros(len(ub), np.int64)
                np.add.at(na, i, wb[j])
                np.add.at(nb, j, wa[i])
                shift = 0 if same else len(ua)
                groups = Groups(len(ua) + (0 if same else len(ub)))
                forest = [(x, y) for x, y in zip(i.tolist(), j.tolist(), strict=True) if groups.join(x, y + shift)]
                counts = [(c, int(n), None) for cs, ns in ((r["classes_a"], na), (r["classes_b"], nb)) for c, n in zip(cs, ns, strict=True) if n]
                links = [(r["classes_a"][x], 0, r["classes_b"][y]) for x, y in forest]
                cols = list(zip(*(counts + links), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["class", "n", "other"])

    found = written(pairs.join(left, "block_a").join(right, "block_b").mapInArrow(lean(join), "class bigint, n bigint, other bigint"), "vector-links")
    counts = found.groupBy("class").agg(F.sum("n").alias("n"))
    roots = components(found.where("other is not null"), "class", "other").withColumnRenamed("node", "class")
    known = classes.drop("vector").join(counts, "class", "left").join(roots, "class", "left").withColumn("component", F.coalesce("component", "class"))
    known = written(known, "linked-classes")
    # Ids come in only here: the least of a component. Written, so that the joins can split hot components and classes.
    least = written(known.groupBy("component").agg(F.min("rep").alias("component_id")), "vector-groups")
    known = written(known.join(least, "component").select(*keys, (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"), "class-groups")
    linked = good.select("vec_id", *keys).join(known, keys).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("sound")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
