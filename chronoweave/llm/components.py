"""Connected components by minimum labels with pointer jumping, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import checkpointed


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, root) for every end of an edge; root is the least node of its component.

    Nulls and self loops are ignored. An empty edge table gives an empty result. Each round combines minima
    on the map side, so that a node with very many edges meets no single task.
    """
    one = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    both = checkpointed(one.union(one.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        low = labels.join(near, "node").select("node", F.least("root", "near").alias("low"), F.col("root").alias("old"))
        low = checkpointed(low)
        up = low.select(F.col("node").alias("low"), F.col("low").alias("upper"))
        new = checkpointed(low.join(up, "low", "left").select("node", F.least("low", F.coalesce("upper", "low")).alias("root"), "old"))
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")
