"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyleaf.session import cut_lineage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Nodes may be of any ordered type. Nulls and loops are ignored; an empty table gives no rows. Each round replaces
    a node's larger neighbours' links (then its smaller ones') by links to its smallest neighbour, so the graph falls
    into stars in about log(nodes) rounds. Minima are combined before they are shuffled, and the joins are plain
    inner joins that adaptive execution splits at hot nodes. Every round is cut by a reliable checkpoint.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    links = cut_lineage(links)
    for _ in range(max_rounds):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where(F.col("u") != F.col("v")).distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small_min, "u").select(F.col("v").alias("u"), F.col("m").alias("v"), "m", F.col("u").alias("w"))
        small = hung.select("u", "v").union(hung.select(F.col("w").alias("u"), F.col("m").alias("v"))).where(
            F.col("u") != F.col("v")).distinct()
        after = cut_lineage(small)
        changed = after.join(links, ["u", "v"], "left_anti").limit(1).count() + links.join(after, ["u", "v"], "left_anti").limit(1).count()
        links = after
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
