"""Connected components over an edge table, and their small counterpart inside one numpy task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage


def contract(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Merge the sets of the pairs (i, j) in the forest parent (each node's root, the smallest index of its set)."""
    while len(i):
        a, b = parent[i], parent[j]
        open_ = a != b
        if not open_.any():
            break
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        low = np.minimum(a, b)
        np.minimum.at(parent, a, low)
        np.minimum.at(parent, b, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, component (smallest node reachable) for every node of an edge; null ends and loops are ignored.

    Each round a node takes the smallest label among its neighbours, its old label's node takes it too, and labels
    jump to their labels' labels, so paths shorten by halves. Labels lie in staged tables: rounds don't build on
    another's lineage. A node with very many edges meets only aggregates (combined before the shuffle) and plain joins
    (split by AQE where they are skewed).
    """
    e = edges.select(F.col(a).cast("long").alias("x"), F.col(b).cast("long").alias("y")).where("x <> y")
    e = stage(e.union(e.select(F.col("y"), F.col("x"))).toDF("src", "dst").distinct(), "edges")
    labels = stage(e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        heard = e.join(labels, e.dst == labels.node).groupBy("src").agg(F.min("label").alias("m"))
        news = labels.join(heard, F.col("node") == F.col("src")).where("m < label")
        both = F.explode(F.array(F.struct(F.col("node").alias("n"), "m"), F.struct(F.col("label").alias("n"), "m")))
        news = news.select(both.alias("z")).groupBy(F.col("z.n").alias("n")).agg(F.min("z.m").alias("m"))
        hooked = stage(labels.join(news, F.col("node") == F.col("n"), "left").select("node", F.least("label", F.coalesce("m", "label")).alias("label"), F.col("label").alias("old")), "hooked")
        up = hooked.select(F.col("node").alias("n"), F.col("label").alias("top"))
        jumped = stage(hooked.join(up, F.col("label") == F.col("n")).select("node", F.col("top").alias("label"), (F.col("top") != F.col("old")).alias("changed")), "labels")
        unstage(labels)
        unstage(hooked)
        labels = jumped
        if labels.where("changed").limit(1).count() == 0:
            unstage(e)
            return labels.select("node", F.col("label").alias("component"))
