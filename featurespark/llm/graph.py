"""Connected components of a link table, in Spark rounds of neighbour minimum and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the link table's two columns; component is the smallest node reachable.

    Every round takes the minimum over neighbours and over the component's own label, so paths shorten to half.
    Labels are written to the shared folder each round. Null ends and links of a node with itself are allowed.
    """
    a, b = links.columns
    links = links.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    first = both.groupBy("u").agg(F.min("v").alias("v"))
    labels = written(first.select("u", F.least("u", "v").alias("c")))
    while True:
        near = both.join(labels.withColumnsRenamed({"u": "v"}), "v").groupBy("u").agg(F.min("c").alias("m"))
        new = labels.join(near, "u").select("u", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        top = labels.select(F.col("u").alias("c"), F.col("c").alias("up"))
        new = new.join(top, "c", "left").select("u", F.least("c", "up").alias("c"), "old")
        new = written(new)
        changed = new.filter("c <> old").limit(1).count()
        drop_written(labels)
        labels = new
        if not changed:
            drop_written(both)
            return labels.select(F.col("u").alias("node"), F.col("c").alias("component"))
