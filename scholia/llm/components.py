"""Connected components by star contraction: no link or component is ever collected by the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.scratch import Scratch

#: Contracted links (16 bytes each) that one task may finish alone; more go on in distributed rounds.
ONE_TASK = 1 << 20
#: Links that a task holds before it contracts them.
HELD = 1 << 18


def _union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the links a - b: vectorised hooking and pointer jumping."""
    ids, code = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = code[: len(a)], code[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        before = root.copy()
        np.minimum.at(root, root[u], low)
        np.minimum.at(root, root[v], low)
        while True:
            hop = root[root]
            if (hop == root).all():
                break
            root = hop
        if (root == before).all():
            return ids, ids[root]


def _links(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links of the batches, about `most` at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy() for k in ("a", "b")))
        if sum(len(x) for x, _ in held) >= most:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace a task's links by stars from each node to its smallest: fewer, shorter links, same components."""
    for a, b in _links(batches, HELD):
        if len(a):
            node, root = _union(a, b)
            keep = node != root
            yield pa.RecordBatch.from_arrays([pa.array(root[keep]), pa.array(node[keep])], names=["a", "b"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for a, b in _links(batches, 1 << 62):
        node, root = _union(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "component"])


def components(links: DataFrame, s: Scratch, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node, component (its smallest reachable node) for every node of links (a, b: long, any order).

    Tasks contract their own links first. What remains is finished by one task if it has at most `one_task` links, a
    checked bound. Otherwise a round follows: each node learns its smallest neighbour (partial sums, so a hub is no hot
    group) and links move there; a graph that never gets small ends when every link leads from a root to a leaf of one
    star, after O(log n) rounds.
    """
    edges = s.keep(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).mapInArrow(_contract, "a long, b long").distinct(), "links")
    for _ in range(most_rounds):
        if edges.count() <= one_task:
            return s.keep(edges.coalesce(1).mapInArrow(_finish, "node long, component long"), "components")
        # large star: for a node u, every larger neighbour points to the smallest of u's neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = s.keep(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("u"), F.least("a", "low").alias("low")), "low")
        done = edges.join(low.withColumnRenamed("u", "a"), "a").where("low < a").limit(1).count() == 0
        if done:
            twice = edges.groupBy("b").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
            if not twice:
                break
        lab = low.select(F.col("u").alias("b"), F.col("low").alias("lb"))
        moved = edges.join(low.withColumnRenamed("u", "a").withColumnRenamed("low", "la"), "a").join(lab, "b")
        root = F.least("la", "lb")
        # both ends keep a link to the smallest node that either of them knows
        new = moved.select(F.explode(F.array(F.struct(root.alias("a"), F.col("a").alias("b")), F.struct(root.alias("a"), F.col("b").alias("b")))).alias("e")).select("e.*").where("a <> b")
        edges = s.keep(new.mapInArrow(_contract, "a long, b long").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    leaves = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return leaves.union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
