"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skuflow.session import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round over ``a``, ``b`` with ``b`` the smaller end.

    Large: every node sends its larger neighbours to the smallest node around it. Small:
    it sends itself and its smaller neighbours there.
    """
    if large:
        around = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    else:
        around = edges
    around = around.toDF("u", "v")
    least = around.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("_u"), F.least("u", "m").alias("m")
    )
    joined = around.join(least, around["u"] == least["_u"])
    if large:
        sent = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select(F.col("_u").alias("a"), F.col("m").alias("b"))
        sent = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(own)
    return sent.where("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it reaches, for every node that has links.

    Rounds go on until a whole round changes nothing; each is staged, so lineage stays
    short. A hub has one row for each neighbour, and the joins are on both sides' shuffles,
    which adaptive execution may split.
    """
    edges = stage(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a != b").distinct(),
        "star-edges",
    )
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select("b", "b").distinct().toDF("node", "root")
            )
        before = state
        edges = stage(_star(_star(edges, large=True), large=False), "star-edges")
