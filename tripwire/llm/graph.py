"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwire.llm.common import temporary, written


def components(edges: DataFrame) -> DataFrame:
    """``(key, root)`` for every key in ``edges(a, b)``; ``root`` is the least key of the component.

    Each round takes the least label of a key's neighbours and then the label of that label, so
    that chains shorten by half or more. Labels are written to the shared folder each round; only
    the number of changed labels comes to the driver.
    """
    spark = edges.sparkSession
    with temporary(spark):
        both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
        labels = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("root")), "labels")
        while True:
            with temporary(spark):
                seen = both.join(labels.select(F.col("key").alias("a"), "root"), "a").groupBy("b").agg(F.min("root").alias("near"))
                near = labels.join(seen.withColumnRenamed("b", "key"), "key").select("key", F.col("root").alias("old"), F.least("root", "near").alias("root"))
                near = written(near, "near")
                jump = near.select(F.col("key").alias("root"), F.col("root").alias("far"))
                new = written(near.join(jump, "root").select("key", "old", F.least("root", "far").alias("root")), "labels", keep=True)
            changed = new.filter("old != root").limit(1).count()
            if not changed:
                return written(new.select("key", "root"), "components", keep=True)
            labels = new.select("key", "root")
