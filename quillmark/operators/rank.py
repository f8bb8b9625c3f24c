"""Exact global ranks, prefix sums and quantiles without a one-task window.

Pattern: cut the order key into buckets by a function of the key alone, total the buckets (a table as
small as the number of buckets), and add each bucket's offset to sums taken inside the bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = "_bucket"

# Up to this many ids of top rows are broadcast.
BROADCAST_IDS = 1_000_000


def bucket_count(df: DataFrame) -> int:
    """Buckets for the session's width: about two per shuffle partition, a power of two from 64 to 4096."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << min(12, max(6, (2 * width - 1).bit_length()))


def split_points(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Approximate quantiles of a column, as bucket edges.

    They only balance the work: any edges give the same result. One pass, mergeable sketches.
    """
    buckets = buckets or bucket_count(df)
    probs = [i / buckets for i in range(1, buckets)]
    points = df.stat.approxQuantile(column, probs, 0.5 / buckets)
    return sorted({float(p) for p in points if math.isfinite(p)})


def with_bucket(df: DataFrame, column: str, points: Sequence[float]) -> DataFrame:
    """Add the bucket of a numeric column; equal values always share a bucket."""
    if not points:
        return df.withColumn(BUCKET, F.lit(0))
    edges = [-math.inf, *points, math.inf]
    bucketed = Bucketizer(splits=edges, inputCol=column, outputCol=BUCKET, handleInvalid="keep").transform(df)
    return bucketed.withColumn(BUCKET, F.col(BUCKET).cast("int"))


def with_hash_bucket(df: DataFrame, key: str, key_bits: int) -> DataFrame:
    """Bucket of a uniform hash: its leading bits."""
    shift = key_bits - int(math.log2(bucket_count(df)))
    return df.withColumn(BUCKET, F.shiftright(F.col(key), shift))


def prefix_sums(
    df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column | str], by: Sequence[str] = ()
) -> DataFrame:
    """Add, for each entry ``n`` of ``sums``, the sum over all earlier rows of the group as ``n`` and the
    sum over the whole group as ``n_total`` (both BIGINT).

    ``df`` needs the bucket column, which is dropped again. ``order`` must be unique within a group and
    must put lower buckets first. Only rows of one bucket of one group ever meet in a task's window.
    """
    values = {name: (F.col(c) if isinstance(c, str) else c) for name, c in sums.items()}
    # A struct makes missing group values equal to each other, in windows and joins alike.
    df_cols = df.drop(BUCKET).columns
    grouped = df.withColumn("_g", F.struct(*by) if by else F.lit(0))
    totals = grouped.groupBy("_g", BUCKET).agg(*[F.sum(c).cast("bigint").alias(n) for n, c in values.items()])
    group = Window.partitionBy("_g")
    before = group.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_g").alias("_o_g"),
        F.col(BUCKET).alias("_o_bucket"),
        *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_o_{n}") for n in values],
        *[F.sum(n).over(group).alias(f"_t_{n}") for n in values],
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per bucket at most
    inside = Window.partitionBy("_g", BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = grouped.select(
        "*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"_l_{n}") for n, c in values.items()]
    )
    # Every bucket has its offset; as a left join this adds no null filter to one side only, so both
    # sides share one shuffle of their common input.
    joined = local.join(offsets, (F.col("_g") == F.col("_o_g")) & (F.col(BUCKET) == F.col("_o_bucket")), "left")
    return joined.select(
        *df_cols,
        *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).cast("bigint").alias(n) for n in values],
        *[F.col(f"_t_{n}").cast("bigint").alias(f"{n}_total") for n in values],
    )


def global_rank(df: DataFrame, key: str, ties: Sequence[str], key_bits: int, name: str = "rank",
                by: Sequence[str] = ()) -> DataFrame:
    """0-based exact rank by a uniform hash key, ties broken by ``ties``."""
    bucketed = with_hash_bucket(df, key, key_bits)
    return prefix_sums(bucketed, [key, *ties], {name: F.lit(1)}, by).drop(f"{name}_total")


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (), weight: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles as rows (by..., prob, quantile).

    Works on the histogram of values, which stays spread over the cluster, so a column of all-distinct
    doubles needs no task that holds them all.
    """
    by = list(by)
    points = split_points(df, value, buckets)
    n = F.sum(F.col(weight)) if weight else F.count(F.lit(1))
    hist = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(n.cast("bigint").alias("_n"))
    ranked = prefix_sums(with_bucket(hist, value, points), [value], {"_before": "_n"}, by)
    wanted = ranked.withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    pos = (F.col("_before_total") - 1) * F.col("prob")

    def holds(rank: Column) -> Column:
        return (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))

    lo, hi = holds(F.floor(pos)), holds(F.ceil(pos))
    # At most two histogram rows per group and probability are left.
    picked = wanted.where(lo | hi).groupBy(*by, "prob").agg(
        F.max(F.when(lo, F.col(value))).cast("double").alias("_low"),
        F.max(F.when(hi, F.col(value))).cast("double").alias("_high"),
        F.first(pos - F.floor(pos)).alias("_part"),
    )
    return picked.select(
        *by, "prob", (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_part")).alias("quantile")
    )


def top_n(df: DataFrame, order: Sequence[Column], row_id: str, n: int) -> DataFrame:
    """First ``n`` rows in ``order`` (which must end in the unique row id), sorted.

    A plain sort with limit lets every task send n full rows to a single one. Here ids and order columns
    alone are reduced in hash groups first; the n winners are then fetched by their ids, which are
    broadcast unless very many are asked for.
    """
    groups = bucket_count(df)
    inside = Window.partitionBy("_group").orderBy(*order)
    ids = (
        df.withColumn("_group", F.pmod(F.xxhash64(row_id), F.lit(groups)))
        .withColumn("_rn", F.row_number().over(inside))
        .where(F.col("_rn") <= n)
        .orderBy(*order)
        .limit(n)
        .select(row_id)
    )
    ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
    return df.join(ids, row_id, "left_semi").orderBy(*order).limit(n)
