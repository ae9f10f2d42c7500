"""Connected components over an edge table, by hooking to the least neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qaflow.llm.common import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Label every node of ``edges`` with the least node that it reaches.

    Returns ``(node, root)``. Each round hooks a node to its least smaller neighbour, follows the
    pointers to the tree's root and contracts the edges; at least half of the nodes with edges go in
    each round, so the rounds grow with the logarithm of the input. All state is in tables in the
    shared folder; nothing is collected but one flag a step. Nulls, self loops and repeated edges
    are ignored; an empty edge table gives an empty result. Hot nodes only meet aggregates with
    partial sums and equi-joins that adaptive execution may split.
    """
    scratch = Scratch(edges.sparkSession)
    live = scratch.write(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges"
    )
    labels = None
    while not live.isEmpty():
        hook = scratch.write(live.groupBy("u").agg(F.min("v").alias("p")), "hook")
        while True:
            up = hook.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = scratch.write(
                hook.join(up, "p", "left").select(
                    "u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")
                ),
                "jump",
            )
            scratch.drop(hook)
            hook = jumped
            if hook.where("moved").isEmpty():
                break
        last = labels
        if labels is None:
            ends = live.select(F.col("v").alias("node")).distinct()  # before the join, as one node may end very many edges
            roots = ends.join(hook.select(F.col("u").alias("node")), "node", "left_anti")
            labels = hook.select(F.col("u").alias("node"), F.col("p").alias("root")).unionByName(
                roots.select("node", F.col("node").alias("root"))
            )
        else:
            labels = labels.join(hook.select(F.col("u").alias("root"), "p"), "root", "left").select(
                "node", F.coalesce("p", "root").alias("root")
            )
        labels = scratch.write(labels, "labels")
        one = hook.select("u", F.col("p").alias("pu"))
        two = hook.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        moved_edges = live.join(one, "u").join(two, "v", "left").select("pu", F.coalesce("pv", "v").alias("pv"))
        left = scratch.write(
            moved_edges.select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).where("u <> v").distinct(),
            "edges",
        )
        scratch.drop(live, hook, *([] if last is None else [last]))
        live = left
    if labels is None:
        return live.select(F.col("u").alias("node"), F.col("v").alias("root"))
    scratch.drop(live)
    return labels
