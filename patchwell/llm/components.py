"""Connected components over link tables too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import store


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of `links` (u, v bigint): the smallest node reachable, itself included.

    Every node hooks to its smallest neighbour if that is smaller, pointers are followed to the
    root, and the links are contracted to links between roots, until none is left: each round at
    least halves the nodes of an unfinished component. Loops and repeated links do no harm; no links give no rows.
    """
    links = store(links.select(F.col("u").cast("long"), F.col("v").cast("long")).filter("u <> v").distinct(), "links")
    known = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = store(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root")), "roots")
        while True:
            over = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = store(up.join(over, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
            up = jumped.select("node", "root")
            if jumped.filter("moved").isEmpty():
                break
        if known is None:
            known = up
        else:
            far = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            known = store(known.join(far, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "known")
        a = up.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        b = up.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        links = store(links.join(a, "u").join(b, "v").filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct(), "links")
    if known is None:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return known.select("node", F.col("root").alias("component"))
