"""Joining rows to a table by a key that many of the rows may share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the rows are thought of as dealt in; a key with more rows than a part is spread over several tasks.
PARTS = 1000


def attach(rows: DataFrame, table: DataFrame, key: str, counts: DataFrame | None = None, how: str = "left") -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each ``key`` and no other column in common.

    A key that more than one in `PARTS` rows have is hot. There are fewer hot keys than parts, so they can be sent to every
    task; their rows are dealt over as many tasks as they fill parts, and their row of the table is repeated for each. So no
    task gets more than a part's rows of one key, and the table grows by at most twice `PARTS` rows.

    ``counts`` (key, n) are the rows' numbers where they are known. ``rows`` should be a scan or narrow steps on one.
    ``how``: ``left`` or ``inner``. Rows without a key match nothing.
    """
    if counts is None:
        counts = rows.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    part = max(total / PARTS, 1.0)
    hot = counts.where((F.col("n") > part) & F.col(key).isNotNull()).select(key, F.ceil(F.col("n") / part).alias("__parts"))
    hot = F.broadcast(hot)  # fewer than PARTS rows, as each has more than total / PARTS
    parts = F.coalesce(F.col("__parts"), F.lit(1))
    dealt = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts)).drop("__parts")
    repeated = table.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    return dealt.join(repeated.drop("__parts"), [key, "__part"], how).drop("__part")
