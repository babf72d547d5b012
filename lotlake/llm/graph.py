"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotlake.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (node, component) for every node of `links` (u, v); component is the smallest node reachable.

    Each round every node hooks to its least neighbour, if that is below itself, and links are rewritten to
    hooks. Least goes by id in one round, which ends stars, and by hash in the next, which halves chains, so
    rounds grow with the logarithm of the nodes. Hooks are found by an aggregate,
    which combines on the map side; the joins read stored tables, so a node with very many links can be
    split. Loops are ignored; links may repeat and come in either direction.
    """
    edges = scratch.save(links.where("u <> v").select("u", "v").distinct(), "links")
    hooks = []
    while True:
        k = len(hooks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda node: F.struct((F.xxhash64(node, F.lit(k)) if k % 2 else F.lit(0).cast("long")).alias("h"), F.col(node).alias("to"))
        best = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        hooks.append(scratch.save(best.select(F.col("u").alias("node"), F.least("best", rank("u"))["to"].alias("hook")), f"hooks{k}"))
        if edges.isEmpty():
            break
        left = hooks[-1].select(F.col("node").alias("u"), F.col("hook").alias("a"))
        right = hooks[-1].select(F.col("node").alias("v"), F.col("hook").alias("b"))
        moved = edges.join(left, "u").join(right, "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        edges = scratch.save(moved, f"links{k}")
    at = hooks[0]
    for nxt in hooks[1:-1]:
        at = at.join(nxt.select(F.col("node").alias("hook"), F.col("hook").alias("to")), "hook", "left").select("node", F.coalesce("to", "hook").alias("hook"))
    at = scratch.save(at, "roots")
    scratch.drop("links", *[f"{name}{k}" for k in range(len(hooks)) for name in ("links", "hooks")])
    least = scratch.save(at.groupBy("hook").agg(F.min("node").alias("least")), "least")
    # the root itself may be the smallest
    return at.join(least, "hook").select("node", F.least("hook", "least").alias("component"))
