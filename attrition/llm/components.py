"""Connected components of an edge table.

Partitions of at most ``EDGES`` edges are first contracted on their own: each
becomes stars around its smallest nodes. Several partitions are then joined by
alternating star contraction, whose steps are joins and aggregates over the
edges, so that no task ever holds a component. Every round is written to the
shared scratch folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import map_arrow, materialize


EDGES = 1 << 20


def contract(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of every node of the edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        least = np.minimum(la, lb)
        new = label.copy()
        np.minimum.at(new, la, least)
        np.minimum.at(new, lb, least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def _contract_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u: list[np.ndarray] = []
    v: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        node, root = contract(np.concatenate(u), np.concatenate(v))
        apart = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[apart]), pa.array(root[apart])], names=["u", "v"])

    for b in batches:
        u.append(b.column(0).to_numpy())
        v.append(b.column(1).to_numpy())
        if sum(map(len, u)) >= 2 * EDGES:
            yield stars()
            u, v = [], []
    if u:
        yield stars()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction of edges (u > v): each node links the neighbours on one
    side of it (larger ones in a large star, itself and smaller ones in a small
    star) to the least node of its closed neighbourhood."""
    if large:
        arcs = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges.select("u", "v")
    least = arcs.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    linked = arcs.join(least, "u")
    moved = linked.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")) if large else linked.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    if not large:
        moved = moved.unionAll(least.select("u", F.col("least").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (two long columns); the component
    is its smallest node. Edges from a node to itself and null ends are ignored; an
    edge table without others gives no rows."""
    a, b = edges.columns
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = materialize(now, "edges")
    parts = now.count() // EDGES + 1
    now = materialize(map_arrow(now.coalesce(parts), _contract_partitions, "u long, v long"), "edges")
    state = None
    while parts > 1:  # one partition's stars are the components
        now = materialize(_star(_star(now, True), False), "edges")
        after = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == state:
            break
        state = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
