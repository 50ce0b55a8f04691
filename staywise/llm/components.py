"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staywise.llm.common import few
from staywise.session import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its least node) for every node of ``edges`` (columns u, v; longs) but the least ones.

    Each round hangs neighbours on the least node that is known to reach them, until the table
    is a set of stars. A round is two aggregations with partial minima and joins on the node;
    its table is written to the shared folder in a few files, which cuts the lineage.
    """
    hung = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = written(few(edges.filter(F.col("u") != F.col("v")).select(*hung).distinct()), "stars")
    state = _state(now)
    while state[0]:
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(few(large.filter("u != v").distinct()), "stars")
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = written(few(small.select("e.u", "e.v").filter("u != v").distinct()), "stars")
        after = _state(small)
        now, done = small, after == state
        state = after
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
