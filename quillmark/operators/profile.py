"""Class balance, length statistics and split tagging."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.functions import text as X
from quillmark.operators import rank as R
from quillmark.session import stored


def length_features(df: DataFrame, code: str = "code") -> DataFrame:
    """Add n_chars, n_lines and n_whitespace_tokens."""
    return df.withColumns(
        {
            "n_chars": X.n_chars(code),
            "n_lines": X.n_lines(code),
            "n_whitespace_tokens": X.n_whitespace_tokens(code),
        }
    )


def with_label_name(df: DataFrame, label: str = "label") -> DataFrame:
    return df.withColumn("label_name", X.label_name(label))


def class_balance(df: DataFrame, label: str = "label", by: Sequence[str] = ()) -> DataFrame:
    """Rows and percentage per class, within each group of ``by`` (a stage, a split, ...)."""
    by = list(by)
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    # The window runs over the few counted rows.
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(0)])))
    return counts.select(*by, label, "n", (100.0 * F.col("n") / total).alias("pct"))


def balance_by_split(
    df: DataFrame, split: str = "split", label_name: str = "label_name", names: Sequence[str] = ("ai", "human")
) -> DataFrame:
    """One row per split, one count column per class, and their total."""
    counts = [F.count_if(F.col(label_name) == n).alias(n) for n in names]
    known = F.count_if(F.col(label_name).isNotNull()).alias("total")
    return df.groupBy(split).agg(*counts, known)


def distinct_languages(df: DataFrame, language: str = "language") -> DataFrame:
    return df.select(language).distinct().orderBy(language)


def length_counts(
    df: DataFrame, metrics: Sequence[str] = C.LENGTH_METRICS, by: str = "label_name"
) -> DataFrame:
    """Histogram of exact lengths: (metric, by, value, n).

    All length reports start from this table: texts are scanned once, and the counts merge map-side, so
    what is shuffled grows with the number of distinct lengths and not with the rows.
    """
    return (
        df.select(by, *metrics)
        .unpivot([by], list(metrics), "metric", "value")
        .where(F.col("value").isNotNull())
        .groupBy("metric", by, "value")
        .agg(F.count("*").alias("n"))
    )


def length_describe(
    counts: DataFrame, by: str = "label_name", percentiles: Sequence[float] = (0.5, 0.9, 0.95, 0.99)
) -> DataFrame:
    """count, mean, std, min, percentiles (linear) and max per metric and class, from `length_counts`."""
    # Moments around the smallest value: those around zero cancel where values are large and close together. The
    # window holds a metric's distinct lengths.
    low = F.min("value").over(Window.partitionBy("metric", by))
    counts = counts.withColumn("_low", low)
    n, v = F.col("n"), (F.col("value") - F.col("_low")).cast("double")
    names = [f"p{round(100 * p)}" for p in percentiles]
    total = F.sum(n)
    sums = counts.groupBy("metric", by).agg(
        total.alias("count"),
        (F.min("_low") + F.sum(n * v) / total).alias("mean"),
        F.sum(n * v).alias("_s1"),
        F.sum(n * v * v).alias("_s2"),
        F.min("value").alias("min"),
        F.percentile("value", list(percentiles), F.col("n")).alias("_p"),
        F.max("value").alias("max"),
    )
    spread = (F.col("_s2") - F.col("_s1") * F.col("_s1") / F.col("count")) / (F.col("count") - 1)
    return sums.select(
        "metric",
        by,
        "count",
        "mean",
        F.when(F.col("count") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("std"),
        "min",
        *[F.col("_p")[i].alias(name) for i, name in enumerate(names)],
        "max",
    )


def length_quantile(counts: DataFrame, prob: float = 0.99, name: str = "p99") -> DataFrame:
    """Quantile of each metric over all classes together."""
    pooled = counts.groupBy("metric", "value").agg(F.sum("n").alias("n"))
    return pooled.groupBy("metric").agg(F.percentile("value", prob, F.col("n")).alias(name))


def clip_p99(df: DataFrame, column: str, prob: float = 0.99) -> DataFrame:
    """Rows whose value is at most the quantile over all rows; any numeric column."""
    limit = R.exact_quantiles(df, column, [prob]).select("quantile")
    return df.where(F.col(column) <= limit.scalar())


def length_histogram(
    counts: DataFrame, by: str = "label_name", bins: int = C.HISTOGRAM_BINS, prob: float = 0.99
) -> DataFrame:
    """Equal-width bins over the values up to the quantile; density per class integrates to 1.

    Bins span the pooled range of each metric and the last one is closed. Empty bins are left out.
    """
    # A metric's window holds its distinct lengths, which the longest text bounds; not its rows.
    whole = Window.partitionBy("metric")
    kept = counts.withColumn("_p", F.percentile("value", prob, F.col("n")).over(whole)).where(F.col("value") <= F.col("_p"))
    low, high = F.min("value").over(whole), F.max("value").over(whole)
    # Equal ends give one unit-wide range around the value.
    flat = F.col("_high") == F.col("_low")
    ranged = kept.withColumns({"_low": low, "_high": high}).select(
        "metric",
        by,
        "value",
        "n",
        (F.col("_low") - F.when(flat, 0.5).otherwise(0.0)).alias("_lo"),
        (F.when(flat, 1.0).otherwise((F.col("_high") - F.col("_low")).cast("double")) / bins).alias("_w"),
    )
    index = F.least(F.floor((F.col("value") - F.col("_lo")) / F.col("_w")), F.lit(bins - 1)).cast("int")
    binned = ranged.groupBy("metric", by, index.alias("bin"), "_lo", "_w").agg(F.sum("n").alias("n"))
    in_class = F.sum("n").over(Window.partitionBy("metric", by))  # at most `bins` rows each
    return binned.select(
        "metric",
        by,
        "bin",
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_start"),
        "n",
        (F.col("n") / (in_class * F.col("_w"))).alias("density"),
    )


def tag_split(
    df: DataFrame, splits: DataFrame, code: str = "code", split: str = "split", missing: bool = False
) -> DataFrame:
    """Add the split each text belongs to, by exact text; later splits win, no match is ``unknown``.

    A missing text is ``unknown``, unless ``missing``: then it has the split of missing texts.

    The split side is reduced to one narrow row per digest and stored. Its shuffle then lies directly
    below the join, as that of ``df`` does, which is what lets adaptive execution split the partition of
    a text with very many copies; an aggregate in between would prevent it.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in C.SPLITS]), F.col(split))
    digest = F.coalesce(X.digest(code), F.lit(b"")) if missing else X.digest(code)
    tags = splits.groupBy(digest.alias("_digest")).agg(F.max_by(split, order).alias("split"))
    return (
        df.drop("split")
        .withColumn("_digest", digest)
        .join(stored(tags, "split-tags"), "_digest", "left")
        .withColumn("split", F.coalesce("split", F.lit(C.UNKNOWN)))
        .drop("_digest")
    )
