"""Connected components of a graph given as an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sinks.scratch import scratch_path


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a long, b long); the component is its smallest node.

    Each round links every node's larger neighbours to its smallest one, then all its smaller neighbours.
    The edges of a round are saved in the shared folder, which cuts the lineage; rounds end when a round
    changes nothing, after a number of rounds logarithmic in the size. Nulls and loops are ignored.
    """
    spark = edges.sparkSession
    larger, smaller = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    current = edges.where("a is not null and b is not null and a <> b").select(larger, smaller).distinct()
    before = None
    while True:
        place = scratch_path(spark, "edges")
        current.write.parquet(place)
        saved = spark.read.parquet(place)
        state = tuple(saved.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            break
        before = state
        both = saved.union(saved.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = joined.select("e.u", "e.v").where("u <> v").distinct()
    roots = saved.select(F.col("v").alias("node")).distinct()
    return saved.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
