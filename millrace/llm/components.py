"""Connected components by alternating large and small stars; no step holds a node's neighbours in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import staged, unstage


def _mark(df: DataFrame):
    return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()


def components(edges: DataFrame) -> tuple[DataFrame, str]:
    """(a, b) for every node a that isn't the smallest of its component, with that smallest node b; and the table's path.

    edges: (a, b) of any order, repeated or not; nulls and loops are no edges. Minima are aggregated before the exchange, and joined
    back by a join that Spark may split where a node has many neighbours.
    """
    spark = edges.sparkSession
    now, path = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).select("b", "m").where("b <> m")
        after, old = low.select("a", F.col("m").alias("b")).union(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), path
        now, path = staged(after, "edges")
        before, mark = mark, _mark(now)
        unstage(spark, old)
        if mark == before:
            break
    return now, path
