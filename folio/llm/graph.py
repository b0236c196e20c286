"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so a node with very many neighbours is never
collected; AQE may split it. Each round is written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """edges: columns u, v (long; self loops, repeats and either direction allowed).

    Returns (node, root) for every node of an edge that isn't its component's smallest node,
    one row each. An empty table gives an empty table; rows with a null end are ignored.
    """
    e = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    e = materialize(e.distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == before or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialize(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
