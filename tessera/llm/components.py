"""Connected components of a link table, as repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import Stage


def components(links: DataFrame, stage: Stage, name: str) -> DataFrame:
    """(node, comp) for each node of links (a, b); comp is its component's least node.

    Every round takes the least label among the neighbours and then the label of
    that label (pointer jumping), so rounds grow with the logarithm of a path's
    length. Each round is written to the shared folder.
    """
    edges = stage.save(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("node", "other"), f"{name}-edges")
    labels = stage.save(edges.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        near = stage.save(near, f"{name}-near-{step}")
        nearer = labels.join(near, "node").select("node", F.col("comp").alias("before"), F.least("comp", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("comp").alias("jumped"))
        # The other end of a jump keeps its own label of the round before.
        after = nearer.join(jump, "via", "left").select("node", "before", F.least("via", F.coalesce("jumped", "via")).alias("comp"))
        after = stage.save(after, f"{name}-{step}")
        changed = not after.where("comp <> before").isEmpty()
        labels = after.select("node", "comp")
        stage.drop(f"{name}-near-{step}", f"{name}-{step - 1}")
        if not changed:
            stage.drop(f"{name}-edges")
            return labels
