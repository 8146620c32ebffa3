"""Connected components of an edge list, as DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kumiki.llm.shared import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node of its component, for every node of edges (a, b).

    Each round takes the smallest label of the neighbours and then the label of that label; nodes far apart meet in a
    logarithmic number of rounds. Every round is written to the shared folder, which cuts the lineage.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    step = None
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label"))
    labels = written(labels.withColumn("moved", F.lit(True)), "labels")
    while not labels.filter("moved").isEmpty():
        near = (
            both.join(labels.select(F.col("node").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("low"))
        )
        before = (labels, step)
        step = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low"))
        step = written(step, "step")
        far = step.select(F.col("node").alias("low"), F.col("low").alias("to"))
        labels = step.join(far, "low").select("node", F.col("to").alias("label"), (F.col("to") != F.col("label")).alias("moved"))
        labels = written(labels, "labels")
        dropped(*before)
    dropped(both, step)
    return labels.select("node", "label")
