"""Connected components of a link table by alternating star contractions.

Each round replaces every link by links to the smallest neighbour, first from the larger side and
then from the smaller one, so the links become stars in a logarithmic number of rounds. A round is
two grouped minima (combined before the shuffle) and two equi-joins (which adaptive execution can
split where a hub has very many links); only two numbers a round reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import dropped, fresh_path, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node that has a link to another.

    Self links, repeated links and links with a null end are ignored. An empty table gives an empty one. Each round's
    links are written to the shared folder, and the round before is deleted.
    """
    spark = links.sparkSession
    edges = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path = fresh_path(spark, "links")
    edges = stored(edges, "links", path)
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        contracted = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, path = path, fresh_path(spark, "links")
        edges = stored(contracted, "links", path)
        dropped(spark, last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
