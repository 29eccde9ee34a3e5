"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import Scratch, saved, spread_join


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) for each node of an edge table (a, b), component being the smallest node reachable.

    Null ends and loops are ignored, repeated edges count once; an empty table gives an
    empty result. Every step is a partial minimum by node and a join of the edges with
    it, in which the neighbours of a hub are cut into pieces, so no task ever holds them
    all. Each step's edges are a table in the shared folder, deleted at the end.
    """
    with Scratch(edges.sparkSession) as own:
        e = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u is not null and v is not null and u < v").distinct()
        e = own.saved(e, "edges")
        while True:
            both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
            large = spread_join(both, least, "u", "n", 2 * e.count()).where("v > u").select("v", F.col("m").alias("u")).where("u < v").distinct()
            large = own.saved(large, "large")
            low = large.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
            stars = spread_join(large, low, "v", "n", large.count()).select(F.explode(F.array(F.struct(F.col("v").alias("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
            e = own.saved(stars.select("x.v", "x.u").where("u < v").distinct(), "edges")
            # Stars are the end: each node has one root, and no root has one.
            ends = e.groupBy("v").agg(F.count("*").alias("roots")).unionByName(e.select(F.col("u").alias("v"), F.lit(-1).cast("long").alias("roots")).distinct())
            if ends.groupBy("v").agg(F.count_if(F.col("roots") < 0).alias("root"), F.max("roots").alias("most")).where("most > 1 or (root = 1 and most > 0)").isEmpty():
                break
        roots = e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
        found = e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
        return scratch.saved(found, "components") if scratch else saved(found, "components")
