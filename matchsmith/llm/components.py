"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchsmith.llm.common import Scratch

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Edges that a task contracts at a time.
EDGES = 1 << 20


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node of each of ``n`` nodes' components under the edges (i, j)."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return root
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges ``u, v`` of the same components, as stars within each task: a node and the least one it
    is connected with there. No shuffle."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= EDGES:
                yield star(held)
                held, size = [], 0
        if held:
            yield star(held)

    def star(held):
        t = pa.Table.from_batches(held)
        ends = np.concatenate([t["u"].to_numpy(), t["v"].to_numpy()])
        nodes, at = np.unique(ends, return_inverse=True)
        least = nodes[local_components(len(nodes), at[:t.num_rows], at[t.num_rows:])]
        other = least != nodes
        return pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(least[other])], ["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``id, component`` (the least id) of every node of the undirected edges (longs) that has another.

    Each task first contracts its own edges to stars, so the shuffles see a node once a task. A round gives
    each node's neighbours its least neighbour: first to the larger ones (large star), then to the
    smaller ones (small star); it ends when every edge leads from a node to a least one. The
    number of rounds is logarithmic in the longest path. Each round is a written table. A node of very many
    edges is one row of a grouped minimum, joined back to its edges by a join that Spark may split.
    """
    links = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    now = scratch.table(contracted(links).distinct(), "edges")
    while True:
        # stars: every u has one v, and no v is a u
        ends = now.select("u", F.lit(1).alias("out")).unionByName(now.select(F.col("v").alias("u"), F.lit(0).alias("out")).distinct())
        mixed = ends.groupBy("u").agg(F.sum("out").alias("out"), F.count(F.lit(1)).alias("n")).filter("out > 1 or (out = 1 and n > 1)")
        if mixed.isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = scratch.table(contracted(large).distinct(), "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
        after = scratch.table(contracted(small).distinct(), "small-star")
        scratch.release(now, large)
        now = after
    ends = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
