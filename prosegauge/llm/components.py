"""Connected components by smallest labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosegauge.llm.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b): the smallest node that it reaches.

    Every round takes the least label among neighbours and then the label of that
    label, so long chains shrink fast.  Sums are partial before each shuffle and a
    node of very many links is only ever a key of narrow rows.  Each round is
    written to the shared folder; only the count of changes comes to the driver.
    Labels grow with the input, so they are joined by merging and never broadcast.
    """
    both = written(
        links.select("a", "b").union(links.select("b", "a")).filter("a <> b").dropDuplicates(), "links"
    )
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near.hint("merge"), labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        of = labels.select(F.col("node").alias("via"), F.col("label").alias("jump"))
        jumped = lower.join(of.hint("merge"), lower["label"] == of["via"], "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label"))
        step = written(jumped, "labels")
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels
