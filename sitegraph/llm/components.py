"""Connected components by Spark joins."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegraph.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b); the root is a
    node of the component, the same for all of it.

    Each round hooks every root to its smallest neighbouring root, follows these
    hooks to their ends by pointer doubling, and contracts the edges to roots; an
    edge list only ever shrinks.  Rounds grow with the logarithm of the longest
    path.  Tables are written in the shared folder, so nothing is recomputed."""
    both = edges.select("a", "b").where("a != b")
    live = scratch.save(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
                        f"{name}-edges0")
    roots = None
    k = 0
    while not live.isEmpty():  # every round joins components, so it ends
        k += 1
        ends = live.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(
            live.select(F.col("b").alias("x"), F.col("a").alias("y")))
        hooks = scratch.save(ends.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("up")), f"{name}-hooks{k}-0")
        for j in count(1):  # up becomes the end of the chain of hooks
            ups = hooks.select(F.col("x").alias("m"), F.col("up").alias("top"))
            hooks = scratch.save(hooks.join(ups, F.col("up") == F.col("m")).select(
                "x", F.col("top").alias("up"), (F.col("top") != F.col("up")).alias("moved")), f"{name}-hooks{k}-{j}")
            scratch.drop(f"{name}-hooks{k}-{j - 1}")
            moved = not hooks.where("moved").isEmpty()
            hooks = hooks.select("x", "up")
            if not moved:
                break
        if roots is None:
            roots = hooks.select(F.col("x").alias("node"), F.col("up").alias("root"))
        else:
            roots = roots.join(hooks, F.col("root") == F.col("x"), "left").select(
                "node", F.coalesce("up", "root").alias("root"))
        roots = scratch.save(roots, f"{name}-roots{k}")
        one, two = hooks.select(F.col("x").alias("a"), F.col("up").alias("ra")), hooks.select(
            F.col("x").alias("b"), F.col("up").alias("rb"))
        live = scratch.save(live.join(one, "a").join(two, "b").where("ra != rb").select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges{k}")
        scratch.drop(f"{name}-edges{k - 1}")
    if roots is None:
        kind = live.schema["a"].dataType
        return live.select(F.lit(None).cast(kind).alias("node"), F.lit(None).cast(kind).alias("root")).limit(0)
    return roots
