"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import _shared


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node and the smallest node it reaches, for every node of links (a, b).

    Each round a node takes the least label among its own and its neighbours',
    then the label of its label (pointer jumping), so rounds grow with the
    logarithm of the longest chain. Each round is written to the shared folder;
    only the number of labels that changed reaches the driver.
    """
    both = _shared.written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), "links")
    label = _shared.written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", F.least("label", "near").alias("next"), F.col("label").alias("was"))
        up = step.select(F.col("node").alias("next"), F.col("next").alias("up"))
        after = _shared.written(step.join(up, "next", "left").select("node", F.least("next", F.coalesce("up", "next")).alias("label"), "was"), "labels")
        if after.filter("label <> was").isEmpty():
            break
        label = after.select("node", "label")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return label
