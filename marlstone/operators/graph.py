"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import scratch, stored


def components(edges: DataFrame) -> DataFrame:
    """(u, root) of every vertex of (u, v), root the component's least: alternating large-star and small-star steps.  No
    neighbourhood is gathered, and the rounds grow with the logarithm of the longest path.  The least neighbours are a
    table before they are joined, so that adaptive execution can deal the edges of a hub over tasks."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.selectExpr("v as u", "u as v")) if large else edges.selectExpr("greatest(u, v) as u", "least(u, v) as v")
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        hung = both.join(least, "u")
        hung = hung.filter("v > u").selectExpr("v as u", "m as v") if large else hung.selectExpr("v as u", "m as v").unionByName(least.selectExpr("u", "m as v"))
        return hung.filter("u != v").distinct()

    mark = None
    with scratch(edges.sparkSession):
        edges = stored(edges.filter("u != v").distinct(), "edges")
        while True:
            edges = stored(star(star(edges, True), False), "edges")
            now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == mark:
                break
            mark = now
        roots = edges.groupBy("u").agg(F.min("v").alias("root"))
        return stored(roots.unionByName(edges.selectExpr("v as u", "v as root").distinct()), "roots", keep=True)
