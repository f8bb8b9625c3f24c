"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b); a component is called by its smallest id.

    Every round takes the smallest label among an id and its neighbours and then the label of that label, so the rounds
    follow the logarithm of the longest path. No edges: no rows. Loops and repeated edges change nothing.
    """
    # Every id is its own neighbour too, so that one pass gives its label and the smallest around it.
    ways = F.array(*(F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb")))
    both = stored(edges.select(F.inline(ways)).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(
            F.min("label").alias("low"), F.max(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("was")
        )
        # A label is an id of its component, never above the id that has it.
        jump = labels.select(F.col("id").alias("low"), "label")
        after = stored(near.join(jump, "low").select("id", "was", "label"), "labels")
        labels = after.select("id", "label")
        if after.where("was <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
