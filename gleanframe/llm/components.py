"""Connected components by joins: least labels spread along links, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(scratch: Scratch, name: str, links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b); comp is the least node of its component.

    Each round a node takes the least label of its neighbours, then its label's label, so long
    chains need a number of rounds near the logarithm of their length. Tables go to the shared
    folder; only a count comes to the driver.
    """
    both = scratch.table(f"{name}-both", links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = scratch.table(f"{name}-0", both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp")))
    i = 0
    while True:
        i += 1
        near = both.join(now.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("low"))
        step = now.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        step = scratch.table(f"{name}-{i}s", step)
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
        jumped = step.join(up, "comp").select("node", "was", F.least("comp", "top").alias("comp"))
        out = scratch.table(f"{name}-{i}", jumped)
        if out.where("was <> comp").isEmpty():
            return out.select("node", "comp")
        now = out.select("node", "comp")
