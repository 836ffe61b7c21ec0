"""Joining a row's group values back where a group may hold a third of all rows; connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..worktable import materialize

#: A group with over 1 / HOT_SHARE of all rows is looked up in a broadcast table, which has HOT_SHARE rows at most.
HOT_SHARE = 1000


def with_group(df: DataFrame, key: str, rows: int, **aggregates: Column) -> DataFrame:
    """``df`` with the aggregates of its group by ``key`` and the group's size ``n``.

    Groups are aggregated inside tasks before they shuffle. Rows of hot groups then meet their values in
    the broadcast table and don't shuffle; the others join by the key. ``rows`` is the number of rows of ``df`` or more."""
    groups = df.groupBy(key).agg(F.count("*").alias("n"), *[c.alias(k) for k, c in aggregates.items()])
    limit = max(1, rows // HOT_SHARE)
    hot, cold = groups.filter(F.col("n") > limit), groups.filter(F.col("n") <= limit)
    looked = df.join(F.broadcast(hot), key, "left")
    rest = looked.filter("n IS NULL").select(*[c for c in df.columns]).join(cold, key)
    return looked.filter("n IS NOT NULL").unionByName(rest)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) with the smallest node reachable, for every node of the edges (a, b).

    Rounds of contraction: every node hangs on its smallest neighbour if that is smaller, the chains are shortened by
    doubling, and the edges are rewritten to their ends' roots until none is left. Tables are joined as they
    were written, so that Spark can split a root that holds most nodes. Edges are never collected."""
    edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    found = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        parents = materialize(parents, "cc-parents")
        while True:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            parents = materialize(parents.join(up, "root").select("node", F.col("top").alias("root"), (F.col("root") != F.col("top")).alias("moved")), "cc-parents")
            moved = not parents.filter("moved").isEmpty()
            parents = parents.select("node", "root")
            if not moved:
                break
        ra, rb = (parents.select(F.col("node").alias(c), F.col("root").alias("r" + c)) for c in "ab")
        left = materialize(edges.join(ra, "a").select("b", "ra"), "cc-edges")
        edges = left.join(rb, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = materialize(edges, "cc-edges")
        if found is None:
            found = parents
        else:
            up = parents.select(F.col("node").alias("root"), F.col("root").alias("top"))
            found = materialize(found.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "cc-found")
    return found if found is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
