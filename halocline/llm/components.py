"""Connected components of a graph given by its edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.storage import materialise


def local_components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest reachable member of each of n nodes, for edges within a task."""
    labels = np.arange(n) if labels is None else labels.copy()
    while True:
        low = np.minimum(labels[a], labels[b])
        new = labels.copy()
        np.minimum.at(new, labels[a], low)
        np.minimum.at(new, labels[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, labels):
            return labels
        labels = new


def _roots(graph: DataFrame) -> DataFrame:
    """(node, root) of every node of ``graph``: where the way over smallest neighbours ends that are smaller still.

    A node's smallest neighbour is a partial minimum in each task.  Each job goes thrice as far as the one before; nodes without a
    smaller neighbour are their own roots and are not joined.
    """
    both = graph.select("a", "b").union(graph.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")), "graph-roots")
    while True:
        on = rows.where("node <> root").select(F.col("node").alias("at"), F.col("root").alias("next"))
        once = rows.join(on, F.col("root") == F.col("at"), "left").select("node", F.coalesce("next", "root").alias("mid"), F.col("next").isNotNull().alias("far"))
        # who stands at a root already goes no further
        ways = once.where("far").join(on, F.col("mid") == F.col("at"), "left")
        there = once.where("not far").select("node", F.col("mid").alias("root"), F.lit(False).alias("moved"))
        stored = materialise(there.union(ways.select("node", F.coalesce("next", "mid"), F.col("next").isNotNull())), "graph-roots")
        rows = stored.select("node", "root")
        if stored.where("moved").isEmpty():
            return rows


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over ``edges`` (a, b), for every node that has an edge.

    Each round takes every node to its root and leaves the edges between different roots, so the graph shrinks: of the roots at least
    every second is gone after two rounds.  The smallest node of a component is always a root.  Every round is a table in the shared folder.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    graph = materialise(edges.where("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "graph-edges")
    labels = None
    while True:
        roots = _roots(graph)
        to = [roots.select(F.col("node").alias(f"of_{c}"), F.col("root").alias(f"to_{c}")) for c in "ab"]
        moved = graph.join(to[0], F.col("a") == F.col("of_a")).join(to[1], F.col("b") == F.col("of_b")).where("to_a <> to_b")
        graph = materialise(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "graph-edges")
        if labels is None:
            labels = roots.withColumnRenamed("root", "label")
        else:
            later = roots.select(F.col("node").alias("was"), "root")
            labels = labels.join(later, F.col("label") == F.col("was"), "left").select("node", F.coalesce("root", "label").alias("label"))
            labels = materialise(labels, "graph-labels")
        if graph.isEmpty():
            return labels
