"""Connected components of a table of links, without ever collecting it.

Each round every vertex takes the least label among its own and its neighbours', then the label of
that label (pointer jumping), so a chain of n vertices needs about log n rounds.  Labels and links
are written to the shared folder each round: plans stay short, and both sides of each join are
exchanged, so that adaptive execution can split the rows of a vertex that a third of all links name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every vertex of `links` (a, b: long), component its least reachable id.

    Links may be given once or in both directions, repeated, or from a vertex to itself.
    """
    ends = F.inline(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w"))))
    links = durable(links.where("a is not null and b is not null and a <> b").select(ends).distinct())
    labels = durable(links.groupBy("v").agg(F.min("w").alias("m")).select(F.col("v").alias("id"), F.least("v", "m").alias("label")))
    while True:
        near = links.join(labels.select(F.col("id").alias("w"), "label"), "w").groupBy("v").agg(F.min("label").alias("m"))
        low = labels.join(near.withColumnRenamed("v", "id"), "id", "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label"))
        low = durable(low)
        jump = low.select(F.col("id").alias("label"), F.col("label").alias("far"))
        after = durable(low.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")))
        labels = after.select("id", "label")
        if after.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
