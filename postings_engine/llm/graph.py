"""Connected components of a large set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns a, b): root is the least node it reaches.

    Every round joins each node to its least neighbour, follows that pointer once more and contracts
    the links, so a chain halves and a star disappears.  Each round's links and roots are written to
    the shared folder, in few files: a lost executor costs one round at most.  Nothing but counts reaches the
    driver, and hubs are split by Spark's skew join.
    """
    ends = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = stored(links.filter("a <> b").select(*ends).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.min("near").alias("near")).select("node", F.least("node", "near").alias("up"))
        over = least.select(F.col("node").alias("up"), F.col("up").alias("top"))
        moved = least.join(over, "up").select("node", F.col("top").alias("root"))
        if roots is None:
            moved = roots = stored(moved, "roots")
        else:
            moved = stored(moved, "moved")
            onward = moved.select(F.col("node").alias("root"), F.col("root").alias("top"))
            roots = stored(roots.join(onward, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "roots")
        a, b = (moved.select(F.col("node").alias(x), F.col("root").alias(f"{x}_root")) for x in "ab")
        joined = edges.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
        edges = stored(joined.filter("a <> b").select(*ends).distinct(), "links")
    return roots if roots is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
