"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import scope, stage

#: A path of n nodes needs about log2(n) rounds.
MOST_ROUNDS = 100


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that it reaches.

    Each round takes the least label among a node's neighbours, hooks it onto the node and onto the
    node's present label, and then jumps to the label's label. Labels only fall; where a round
    changes none, both ends of every edge agree. Labels stay in the shared folder between rounds, never on the driver.
    """
    with scope(edges.sparkSession) as tables:
        both = stage(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges", narrow=True)
        labels = stage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")), "cc-labels", narrow=True)
        for _ in range(MOST_ROUNDS):
            state = stage(_round(both, labels), "cc-labels", narrow=True)
            labels = state.select("node", F.col("new").alias("component"))
            tables.drop("cc-edges", "cc-labels")
            if state.filter("changed").isEmpty():
                tables.drop("cc-labels")
                return labels
    raise RuntimeError("components didn't settle")


def _round(both: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, new, changed): the labels after one round."""
    near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
    hooked = labels.join(near, labels["node"] == near["a"]).select("node", "component", F.least("near", "component").alias("best"))
    claims = hooked.select("node", "best", "component").union(hooked.select(F.col("component").alias("node"), "best", F.lit(None).cast(labels.schema["component"].dataType).alias("component")))
    claims = claims.groupBy("node").agg(F.min("best").alias("best"), F.min("component").alias("component"))
    up = claims.select(F.col("node").alias("__of"), F.col("best").alias("__up"))
    return claims.join(up, claims["best"] == up["__of"]).select("node", F.least("best", "__up").alias("new"), (F.least("best", "__up") != F.col("component")).alias("changed"))
