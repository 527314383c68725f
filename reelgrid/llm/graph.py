"""Connected components over an edge table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Workspace


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Columns node, root for the nodes of ``edges`` (a, b, 64-bit); nodes that are
    joined by edges share a root, which is one of them.

    Each round every node moves to the neighbour (or itself) with the smallest
    hash and the graph is contracted along these moves, so the number of rounds
    grows with the logarithm of the size.  Groupings combine on the map side and
    joins are plain equi-joins that adaptive execution splits on hot nodes.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = ws.keep(both(edges.where("a <> b")).distinct())
    label = ws.keep(left.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node")))
    turn = 0
    while not left.isEmpty():
        rank = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("h"), F.col(c).alias("v"))
        best = left.groupBy("a").agg(F.min(rank("b")).alias("m"))
        move = ws.keep(best.select(F.col("a").alias("from"), F.least(F.col("m"), rank("a"))["v"].alias("to")))
        step = move.select(F.col("from").alias("b"), F.col("to").alias("to_b"))
        nearer = left.join(move.withColumnRenamed("from", "a"), "a").select(F.col("to").alias("to_a"), "b").join(step, "b")
        after = ws.keep(nearer.where("to_a <> to_b").select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct())
        moved = ws.keep(label.join(move.withColumnRenamed("from", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        ws.drop(left, label, move)
        left, label, turn = after, moved, turn + 1
    ws.drop(left)
    return label


def smallest_reached(i: np.ndarray, j: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a bipartite graph with links (i, j), the
    smallest row that it is connected to (``rows`` for a column without links)."""
    a, b = np.arange(rows), np.full(columns, rows)
    while True:
        np.minimum.at(b, j, a[i])
        low = a.copy()
        np.minimum.at(low, i, b[j])
        low = low[low]
        if (low == a).all():
            return a, b
        a = low
