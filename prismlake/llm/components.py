"""Connected components, by contraction to the least neighbour, and inside one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismlake import runtime


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Least member of the component of each of ``n`` vertices, for edges inside one task."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        on = label[u] != label[v]
        u, v = u[on], v[on]
    return label


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is its least node.

    Each round maps a node to its least neighbour's least neighbour and contracts the edges: a
    star contracts in one round, a path in about log2 of its length. Minima combine on the map
    side, so a node with very many edges is no single task's work. Every round is a stored
    table; only the number of edges left comes to the driver. Edges with a null end and loops are
    ignored; repeated edges don't matter; no edges give no rows.
    """
    spark = edges.sparkSession

    def stage(df: DataFrame, what: str, rows: int) -> DataFrame:
        return runtime.stage_table(df, f"{name}-{what}", files=max(1, rows >> 18))

    # counts of stored tables come from their footers
    left = runtime.stage_table(edges.where("a is not null and b is not null and a != b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), f"{name}-edges", files=runtime.few_files(spark, edges.count()))
    known: DataFrame | None = None
    while size := left.count():
        both = left.select("a", "b").unionByName(left.selectExpr("b a", "a b"))
        parent = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).selectExpr("node", "least(node, least) parent")
        parent = stage(parent, "parents", 2 * size)
        for _ in range(2):
            up = parent.selectExpr("node parent", "parent top")
            parent = parent.join(up, "parent").selectExpr("node", "top parent")
        parent = stage(parent, "tops", 2 * size)
        ends = left.join(parent.selectExpr("node a", "parent pa"), "a").join(parent.selectExpr("node b", "parent pb"), "b")
        left = stage(ends.where("pa != pb").selectExpr("greatest(pa, pb) a", "least(pa, pb) b").distinct(), "edges", size)
        if known is None:
            known = parent.selectExpr("node", "parent component")
        else:
            step = parent.selectExpr("node component", "parent top")
            known = stage(known.join(step, "component", "left").selectExpr("node", "coalesce(top, component) component"), "known", known.count())
    return left.selectExpr("a node", "b component") if known is None else known
