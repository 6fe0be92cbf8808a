"""Connected components of an edge table, by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import drop, materialise

#: Contractions after which an edge table is taken for faulty; each is expected to halve the nodes at least.
MAX_ROUNDS = 60
#: Edges (16 bytes each) that one task settles at once. A contraction is a dozen stages, whatever its edges; larger tables
#: are contracted until they are as small as this, so that no task grows with the input.
FEW = 1 << 16


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _settled(edges: DataFrame) -> DataFrame:
    """(u, t) of every node of at most FEW edges: t is the smallest node that u reaches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for batch in batches if batch.num_rows]
        if ends:
            nodes, number = np.unique(np.concatenate(ends, 1), return_inverse=True)
            root = list(range(len(nodes)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            for x, y in number.reshape(2, -1).T.tolist():
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
            least = nodes[[find(x) for x in range(len(nodes))]]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["u", "t"])

    return edges.coalesce(1).mapInArrow(run, "u long, t long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (a, b) touches; component is the smallest node reachable.

    Each round every node points to the neighbour (or itself) that is first in a random order, one pointer jump
    follows, and edges are rewritten to the targets; edges inside a target vanish. A node with very many
    neighbours costs no more than they do: minima are combined before the shuffle. Once FEW edges are left, one task
    settles them. Loops and repeated edges are ignored, nulls must not occur, an empty table gives an empty one.
    """
    given = materialise(edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    if given.count() <= FEW:
        out = materialise(_settled(given).select(F.col("u").alias("node"), F.col("t").alias("component")))
        drop(given)
        return out
    edges = materialise(given.distinct())
    drop(given)
    nodes = materialise(_both_ways(edges).select(F.col("u").alias("node")).distinct())
    label = materialise(nodes.select("node", F.col("node").alias("at")))
    moved_to = lambda to: materialise(label.join(to.select(F.col("u").alias("at"), "t"), "at", "left").select("node", F.coalesce("t", "at").alias("at")))
    for k in range(MAX_ROUNDS):
        if edges.count() <= FEW:
            break
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("o"), F.col(c).alias("n"))  # noqa: B023, E731
        to = _both_ways(edges).groupBy("u").agg(F.min(F.struct(order("v").alias("x"))).alias("m"), F.min(F.struct(order("u").alias("x"))).alias("own"))
        to = materialise(to.select("u", F.least("m.x", "own.x").getField("n").alias("t")))
        jump = to.select(F.col("u").alias("t"), F.col("t").alias("t2"))
        to2 = materialise(to.join(jump, "t", "left").select("u", F.coalesce("t2", "t").alias("t")))
        moved = edges.join(to2.select(F.col("u").alias("a"), F.col("t").alias("x")), "a").join(to2.select(F.col("u").alias("b"), F.col("t").alias("y")), "b")
        left = materialise(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        new = moved_to(to2)
        for old in (edges, label, to, to2):
            drop(old)
        edges, label = left, new
    else:
        raise RuntimeError("components did not settle")
    last = materialise(_settled(edges))
    new = moved_to(last)
    smallest = new.groupBy("at").agg(F.min("node").alias("component"))
    out = materialise(new.join(materialise(smallest), "at").select("node", "component"))
    for old in (edges, label, last, new, nodes):
        drop(old)
    return out
