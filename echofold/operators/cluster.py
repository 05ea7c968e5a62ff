"""Connected components of an edge table, by contraction.

Each round every node points to its least neighbour (or itself), the pointers are followed to
their roots by doubling, and the edges move to the roots.  Trees of at least two nodes collapse,
so the edges are gone after at most log2(nodes) rounds; chains collapse in one.  All steps are
joins and map-side combined aggregates on DataFrames: nothing is collected but row counts, and a
hub's edges can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def _jump(pointers: DataFrame, scratch: Scratch) -> DataFrame:
    """Pointers (node, root) with every node at its final root; roots point to themselves."""
    held = pointers
    while True:
        up = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        moved = scratch.cut(pointers.join(up, "root").select("node", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("_moved")), "jump")
        again = moved.where("_moved").limit(1).count()
        scratch.drop(held)
        held, pointers = moved, moved.select("node", "root")
        if not again:
            return pointers


def components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the least node of the
    component.

    Null ends, self-loops and repeated edges are ignored; an empty table gives an empty result.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    pair = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    rest = scratch.cut(pair.distinct(), "edges")
    total: DataFrame | None = None
    while rest.limit(1).count():
        # a node's least neighbour: only the greater end of an edge can point down
        down = rest.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
        ends = rest.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
        first = down.unionByName(ends).groupBy("node").agg(F.min("root").alias("root"))
        roots = _jump(scratch.cut(first, "first"), scratch)
        ru, rv = roots.select(F.col("node").alias("u"), F.col("root").alias("ru")), roots.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = rest.join(ru, "u").join(rv, "v").where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        done, rest = rest, scratch.cut(moved, "edges")
        scratch.drop(done)
        if total is None:
            total = roots
        else:
            again = roots.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            past, total = total, scratch.cut(total.join(again, "root", "left").select("node", F.coalesce("_next", "root").alias("root")), "roots")
            scratch.drop(past)
    return total if total is not None else rest.select(F.col("u").alias("node"), F.col("v").alias("root"))
