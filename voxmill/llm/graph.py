"""Connected components by contraction, with bounded rows a round and no driver-side links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxmill.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``edges`` (a, b): nodes of a component share one label.

    Each round every node moves to the least of itself and its neighbours and the edges are
    redrawn between those places, until none is left. A hub is combined before the shuffle.
    """
    edges = stored(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    moves = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = stored(both.groupBy("a").agg(F.least("a", F.min("b")).alias("to")).withColumnRenamed("a", "node"), "steps")
        moves.append(step)
        one, two = step.toDF("a", "ta"), step.toDF("b", "tb")
        edges = edges.join(one, "a").join(two, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")).filter("a <> b")
        edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = moves[0].toDF("node", "label")
    for step in moves[1:]:
        labels = labels.join(step.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return labels
