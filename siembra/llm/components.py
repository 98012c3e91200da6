"""Connected components of an edge table: local contraction, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siembra.llm.shared import materialise


def _least_neighbour(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and all its v beside each row; aggregated before it is joined."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return pairs.join(least, "u")


#: Edges that one task contracts in memory: 16 MB of ids.
CONTRACT = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, root) from every node that isn't the smallest of its component."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while True:  # smaller labels spread over edges and jump to the labels of labels
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars, by at most ``most`` edges in memory (and one batch)."""
    u = v = np.zeros(0, np.int64)
    for batch in batches:
        u, v = np.append(u, batch.column("u").to_numpy()), np.append(v, batch.column("v").to_numpy())
        if len(u) > most:
            u, v = stars(u, v)
            if len(u) > most // 2:
                yield pa.RecordBatch.from_pydict({"u": u, "v": v})
                u = v = np.zeros(0, np.int64)
    if len(u):
        u, v = stars(u, v)
        yield pa.RecordBatch.from_pydict({"u": u, "v": v})


def _are_stars(edges: DataFrame) -> bool:
    """Whether every leaf has one root and no root is a leaf."""
    leaves = edges.groupBy("u").count()
    return leaves.where("count > 1").isEmpty() and edges.join(leaves.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def connected_components(edges: DataFrame, most: int = CONTRACT) -> DataFrame:
    """(node, label) for every node with an edge; label is the smallest node of the component.

    ``edges`` has long columns u and v. Loops, repeated and reversed edges are fine, and so is
    an empty table. Partitions are contracted to stars in bounded memory. Once at most ``most``
    edges are left, one task contracts them; before that each round of large and small stars
    goes to the shared folder. A hub with many edges is combined before the shuffle and split by
    adaptive execution in the join.
    """
    contract = lambda df: df.mapInArrow(lambda it: _contract(it, most), "u long, v long")
    current = materialise(contract(edges.where("u is not null and v is not null and u <> v").select("u", "v")), "edges")
    while current.count() > most:
        if _are_stars(current):
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _least_neighbour(large)
        linked = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        current = materialise(contract(linked.where("u <> v").distinct()), "edges")
    else:
        current = materialise(contract(current.coalesce(1)), "edges")
    return current.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
