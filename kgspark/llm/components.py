"""Connected components of a graph of long ids, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of each node of ``edges`` (u, v).

    Each round every node takes the least label of itself, its neighbours and its label's label; labels reach the smallest node
    in a number of rounds that grows with the logarithm of the longest path. Each round is written, so none is lost.
    """
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = labels.join(near, "node").join(jump, "label").select("node", F.col("label").alias("old"), F.least("label", "near", "far").alias("label"))
        new = written(new, "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.drop("old")
