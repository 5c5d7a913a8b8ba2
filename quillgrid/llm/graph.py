"""Connected components by contraction."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; longs); nodes of a component share a root, one of them.

    In each round every node points at the neighbour (or itself) that is least by a hash of node and round, and the
    graph is contracted to the nodes pointed at; rounds are logarithmic in the component's size.  Each round is written
    to the shared folder.  Nothing of the graph comes to the driver.
    """
    spark = edges.sparkSession
    live = written(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    found = None
    for k in itertools.count():
        if live.isEmpty():
            break
        both = live.union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("by"), F.col(c).alias("is"))  # noqa: B023, E731
        up = both.groupBy("a").agg(F.min(order("b")).alias("m"))
        up = written(up.select(F.col("a").alias("node"), F.when(order("a") < F.col("m"), F.col("a")).otherwise(F.col("m").getField("is")).alias("up")), "up")
        if found is None:
            found = up.select("node", F.col("up").alias("root"))
        else:
            step = up.select(F.col("node").alias("root"), "up")
            found = written(found.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        a, b = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        live = written(live.join(a, "a").join(b, "b").filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    return found if found is not None else spark.createDataFrame([], "node long, root long")
