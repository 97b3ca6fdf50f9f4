"""Connected components of an edge table, without moving edges or labels to the driver.

Each round every node points at its neighbour (or itself) of the lowest mixed id; edges are
rewritten to what their ends point at, and those that became loops or doubles go. Mixing by a new
seed each round makes the number of nodes fall by a factor whatever the shape, so the rounds grow
with the logarithm of the nodes, and the work with the edges. The pointers of all rounds are then
followed from the last round back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthoquilt.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b), roots being nodes: two nodes are connected
    exactly if their roots are equal. Loops and doubles are allowed; no edges give no rows."""
    live = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    pointers: list[DataFrame] = []
    seed = 0
    while live.take(1):
        seed += 1
        both = live.select(F.col("a").alias("v"), F.col("b").alias("n")).union(live.select(F.col("b").alias("v"), F.col("a").alias("n")))
        mix = lambda c: F.struct(F.xxhash64(F.lit(seed), F.col(c)).alias("h"), F.col(c).alias("id"))
        best = both.groupBy("v").agg(F.min(mix("n")).alias("n"))
        to = stored(best.select("v", F.least(mix("v"), F.col("n"))["id"].alias("p")), "points")
        pointers.append(to)
        half = live.join(to.withColumnRenamed("v", "a"), "a").select(F.col("p").alias("x"), "b")
        moved = half.join(to.select(F.col("v").alias("b"), F.col("p").alias("y")), "b")
        live = stored(
            moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges"
        )
    if not pointers:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = pointers[-1].select(F.col("v").alias("node"), F.col("p").alias("root"))
    for to in reversed(pointers[:-1]):
        onward = roots.select(F.col("node").alias("p"), "root")
        roots = stored(to.join(onward, "p", "left").select(F.col("v").alias("node"), F.coalesce("root", "p").alias("root")), "roots")
    return roots
