"""Connected components of small clusters, distributed, within a partition column such as a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivano.session import cut, drop


def components(edges: DataFrame, group: str = "doc_id") -> DataFrame:
    """Label every node of ``edges(group, a, b)`` with the least node it is connected to.

    Minimum-label propagation with pointer jumping, until no label changes; each round is two equi-joins and one
    partial aggregation and ends in a written table that replaces the one before, so no component is ever gathered in
    one task or on the driver.  Nulls and self-loops in ``edges`` are ignored.  Returns ``(group, node, label)`` for
    nodes that have an edge; an empty input gives no rows.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(group, "a", "b")
    both = cut(e.unionByName(e.select(group, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy(group, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = (
            both.join(labels.select(group, F.col("node").alias("b"), "label"), [group, "b"])
            .groupBy(group, F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = labels.join(near, [group, "node"], "left").select(
            group, "node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")
        )
        jump = labels.select(group, F.col("node").alias("label"), F.col("label").alias("up"))
        new = cut(step.join(jump, [group, "label"], "left").select(group, "node", "old", F.least(F.coalesce("up", "label"), "label").alias("label")), labels)
        changed = new.where("old <> label").limit(1).count()
        if not changed:
            drop(both)
            return new.drop("old")
        labels = new.drop("old")
        labels._cut_path = new._cut_path
