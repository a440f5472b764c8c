"""Connected components of links between integer nodes, kept as a table of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtide.sources.shared import observed, written


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after joining the components that ``links`` (a, b) connect; each takes its lowest label.

    In every round each component points to the lowest of those it is linked with, chains of pointers are cut short by
    doubling, and labels follow. Rounds go on until no link crosses; their number grows with the logarithm of the longest chain.
    """
    while True:
        a, b = (labels.select(F.col("node").alias(n), F.col("comp").alias(f"c{n}")) for n in "ab")
        cross = links.join(a, "a").join(b, "b").where("ca != cb")
        up = cross.groupBy(F.greatest("ca", "cb").alias("comp")).agg(F.min(F.least("ca", "cb")).alias("up"))
        up, found = observed(up, "pointers", n=F.count("*"))
        if not found["n"]:
            return labels
        moved = found["n"]
        while moved:
            above = up.select(F.col("comp").alias("up"), F.col("up").alias("top"))
            jumped = up.join(above, "up", "left").select("comp", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
            up, found = observed(jumped, "pointers", n=F.count_if("moved"))
            moved = found["n"]
        labels = written(labels.join(up.select("comp", "up"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "labels")
