"""Connected components of a links table, by alternating large-star and small-star steps.

As soon as the links are few enough to be held by one task, that task does the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import discard, option, written
from .workers import lean

#: So many links (16 bytes each) are followed by one task.
TASK_LINKS = 2_000_000


def least_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links between int64 numbers, and the least node that each can reach."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        x, y = up[a], up[b]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (above := up[up]).tobytes() != up.tobytes():
            up = above
        open_ones = up[a] != up[b]
        a, b = a[open_ones], b[open_ones]
    return nodes, nodes[up]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(batch.column("u").to_numpy(), batch.column("v").to_numpy()) for batch in batches if batch.num_rows]
    if held:
        nodes, least = least_reachable(*(np.concatenate(c) for c in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # Written, so that the join below shuffles both sides and its hot keys can be split.
    least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = written(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct(), least


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with a link.

    ``links`` holds pairs of bigint nodes. Each step is a written table, so the plan stays short
    and a lost executor costs one step. Hot nodes are pre-aggregated by min() before the shuffle
    and their join is one that AQE can split.
    """
    spark = links.sparkSession
    # Rows of one node must meet whatever Spark infers about unions.
    with option(spark, "spark.sql.unionOutputPartitioning", "false"):
        edges = written(links.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v").distinct(), "links")
        before, n = None, edges.count()
        while n > TASK_LINKS:
            large, least = _large_star(edges)
            star = written(large, "star")
            discard(edges, least)
            small, least = _small_star(star)
            edges = written(small, "star")
            discard(star, least)
            # A star forest maps to itself: number and sums of the pairs then stay as they are.
            now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if before == now:
                break
            before, n = now, now[0]
        else:
            out = written(edges.coalesce(1).mapInArrow(lean(_in_one_task), "node bigint, component bigint"), "components")
            discard(edges)
            return out
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        out = written(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots), "components")
        discard(edges)
        return out


class Groups:
    """Union-find over 0..n-1 for one task's rows."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
