"""Connected components of an edge table, in bounded rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.common import cut


def start(edges: DataFrame) -> DataFrame:
    """Every node of ``edges`` (a, b) with itself as its label."""
    both = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    return both.distinct().withColumn("label", F.col("node"))


def step(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node takes the least label of itself and its neighbours, then that label's label.

    A label is always a node of the same component.  Minima are combined before
    they are shuffled, and a node or label with many rows is on the side of the
    join that Spark can split.
    """
    around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = (
        around.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
    )
    moved = labels.join(least, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
    return moved


def jump(moved: DataFrame) -> DataFrame:
    to = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
    return moved.join(to, "label").select("node", "old", F.least("label", "further").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that links reach.  The table is written after each round."""
    labels = cut(start(edges), "labels")
    while True:
        moved = cut(jump(cut(step(labels, edges), "moved")), "labels")
        if moved.where("old <> label").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")
