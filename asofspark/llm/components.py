"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofspark.llm.storage import discard, stored

MAX_ROUNDS = 60


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One step over edges (u > v).

    Large star: every node's larger neighbours are linked to the smallest node around it.
    Small star: so are its smaller neighbours and itself.  The smallest is a grouped minimum
    joined back, so a node with many neighbours is aggregated partially and its join can be
    split; nothing is collected.
    """
    if larger:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    if larger:
        linked = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = around.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node of its component.

    ``a`` and ``b`` are long.  Self loops, repeated edges and both directions are allowed;
    without edges the result is empty.  The rounds grow with the logarithm of the largest
    component; each one is stored in the shared folder, so a lost executor costs one step.
    """
    edges = stored(
        pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    seen = None
    for _ in range(MAX_ROUNDS):
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if tuple(state) == seen or not state["n"]:
            break
        seen = tuple(state)
        after = stored(_star(_star(edges, True), False))
        discard(edges)
        edges = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
