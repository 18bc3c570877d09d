"""Connected components of an edge table.

Up to LOCAL edges, a bound that does not grow with the data, one task's
union-find gives them in one step. More edges take alternating large-star and
small-star steps over the cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session, textkit

MOST_ROUNDS = 60
LOCAL = 500_000

_ROOTED = pa.schema([("node", pa.int64()), ("root", pa.int64())])


def _rooted(batches):
    """(node, root) of all edges (u, v) of one task."""
    pairs = [np.stack([textkit.column(b, c).to_numpy() for c in ("u", "v")], 1) for b in batches]
    if not pairs:
        return
    nodes, flat = np.unique(np.concatenate(pairs), return_inverse=True)
    up = list(range(len(nodes)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in flat.reshape(-1, 2).tolist():
        x, y = find(x), find(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    roots = nodes[np.array([find(i) for i in range(len(nodes))], np.int64)]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], schema=_ROOTED)


def _digest(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours hang on the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours hang on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b): root is the least node that can be reached. Both columns long; loops and repeats do no harm, an empty table gives an empty one."""
    turned = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = session.materialize(turned)
    before = _digest(edges)
    if before[0] <= LOCAL:
        return session.materialize(edges.repartition(1).mapInArrow(_rooted, "node long, root long"))
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        edges = session.materialize(_small(_large(edges)))
        now = _digest(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
