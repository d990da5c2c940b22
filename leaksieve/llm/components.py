"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leaksieve.llm.common import saved


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge; ``root`` is the component's least node.

    In each round a node and its root take the least grandparent among the neighbours,
    then every pointer skips one level, so rounds grow with the logarithm of the
    longest path. Each round is written to the shared folder. Self-loops and repeated
    edges are harmless; nulls are no nodes.
    """
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("nbr")).filter(
        "node IS NOT NULL AND nbr IS NOT NULL"
    )
    pairs = saved(
        e.unionByName(e.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"))).distinct(),
        "cc-pairs",
    )
    state = saved(
        pairs.groupBy("node").agg(F.min("nbr").alias("m")).select("node", F.least("node", "m").alias("root")),
        "cc-state",
    )
    while True:
        up = state.select(F.col("node").alias("root"), F.col("root").alias("top"))
        grand = state.join(up, "root").select("node", "root", "top")
        near = (
            pairs.join(grand.select(F.col("node").alias("nbr"), "top"), "nbr")
            .groupBy("node")
            .agg(F.min("top").alias("m"))
        )
        found = grand.join(near, "node").select("node", "root", F.least("m", "top").alias("m"))
        hooks = (
            found.select(F.col("root").alias("node"), "m")
            .unionByName(found.select("node", "m"))
            .groupBy("node")
            .agg(F.min("m").alias("m"))
        )
        hooked = saved(
            state.join(hooks, "node").select(
                "node", F.col("root").alias("was"), F.least("root", "m").alias("root")
            ),
            "cc-hooked",
        )
        up = hooked.select(F.col("node").alias("root"), F.col("root").alias("top"))
        state = saved(
            hooked.join(up, "root").select("node", "was", F.col("top").alias("root")), "cc-state"
        )
        if state.filter("root != was").isEmpty():
            return state.select("node", "root")
        state = state.select("node", "root")
