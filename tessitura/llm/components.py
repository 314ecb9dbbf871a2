"""Connected components of an edge table, by rounds of hooking, pointer jumping and contraction.

Every round reduces the graph with equi-joins and partial aggregates only; nothing is collected but row counts,
and each intermediate is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessitura.llm.common import durable, forget


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges (u, v) with u > v; loops and nulls go."""
    return (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter(F.col("u") != F.col("v"))
        .distinct()
    )


def _jump(parents: DataFrame) -> DataFrame:
    """Replace every parent by its own parent where it has one."""
    up = parents.select(F.col("node").alias("up_node"), F.col("parent").alias("up_parent"))
    return parents.join(up, F.col("parent") == F.col("up_node"), "left").select(
        "node", F.coalesce("up_parent", "parent").alias("parent"), F.col("up_parent").isNotNull().alias("moved")
    )


def _roots(parents: DataFrame) -> DataFrame:
    """Pointer jumping until no parent has a parent of its own; log2(depth) passes."""
    before = parents
    while True:
        after = durable(_jump(parents), "jump")
        forget(before)
        if after.filter("moved").isEmpty():
            return after
        before, parents = after, after.select("node", "parent")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v) that is not its component's smallest one.

    component is the smallest node reachable. Loops, repeated edges and null ends are ignored; an empty edge
    table gives an empty result. Nodes that the result lacks are their own component.
    """
    graph = durable(_ordered(edges), "edges")
    labels = None
    while not graph.isEmpty():
        parents = durable(graph.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("parent")), "parents")
        roots = _roots(parents)
        own = roots.select("node", F.col("parent").alias("component"))
        if labels is not None:
            step = roots.select(F.col("node").alias("old"), F.col("parent").alias("new"))
            moved = labels.join(step, F.col("component") == F.col("old"), "left").select(
                "node", F.coalesce("new", "component").alias("component")
            )
            own = moved.unionByName(own)
        merged = durable(own, "labels")
        forget(*([labels] if labels is not None else []))
        labels = merged
        to_u = roots.select(F.col("node").alias("u"), F.col("parent").alias("root_u"))
        to_v = roots.select(F.col("node").alias("v"), F.col("parent").alias("root_v"))
        joined = graph.join(to_u, "u", "left").join(to_v, "v", "left")
        left = durable(
            _ordered(joined.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))), "edges"
        )
        forget(graph, roots)
        graph = left
    if labels is None:
        return graph.select(F.col("u").alias("node"), F.col("v").alias("component"))
    forget(graph)
    return labels
