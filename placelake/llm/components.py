"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placelake.llm.common import apart, checkpoint


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links; each node but a component's smallest, with that smallest."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    half = len(a)
    for x, y in zip(ends[:half].tolist(), ends[half:].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
    for k in range(len(parent)):  # parents are smaller and so already final
        parent[k] = parent[parent[k]]
    root = np.array(parent, dtype=np.int64)
    moved = root != np.arange(len(root))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def components(links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of `links` (long columns a, b); root is the smallest node reachable.

    Links of a batch are contracted where they lie, then stars alternate until the link set is stable. The minimum of a
    node's neighbours is a partial aggregate, so that a hub costs one row per task; the join that follows can be split
    by adaptive execution. Links with a null end, and loops, link nothing.
    """
    clean = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a != b")
    edges = checkpoint(clean.mapInArrow(_contract, "a long, b long").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(apart(F.col("a")).alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(apart(F.col("a")).alias("k"), "m")
        small = large.join(low, large.a == low.k).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = checkpoint(small.unionByName(low.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    root = edges.groupBy("a").agg(F.min("b").alias("root"))
    return root.select(F.col("a").alias("node"), "root").unionByName(root.select(F.col("root").alias("node"), "root").distinct())
