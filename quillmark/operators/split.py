"""Seeded, exact stratified splits and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.functions import text as X
from quillmark.operators import rank as R

# Above this many classes the table of cut points is joined by shuffle instead of broadcast.
BROADCAST_CLASSES = 100_000


def check_ratios(train: float, validation: float, test: float) -> None:
    if min(train, validation, test) <= 0:
        raise ValueError(f"split ratios must be positive: {train}, {validation}, {test}")
    if abs(train + validation + test - 1.0) > 1e-6:
        raise ValueError(f"split ratios must add up to 1: {train + validation + test:.6f}")


def split_quotas(
    counts: DataFrame, ratios: Sequence[float] = (C.TRAIN_RATIO, C.VALIDATION_RATIO, C.TEST_RATIO)
) -> DataFrame:
    """Rows of every class per split, from a table (stratum, n).

    Two draws: the test part of everything, then the validation part of the rest. A draw's size is the
    rounded-up share; what remains is dealt to classes in proportion, by largest remainder, equal
    remainders in class order.
    """
    train, validation, test = ratios
    everything = Window.partitionBy(F.lit(0))  # one row per class

    def draw(table: DataFrame, available: str, fraction: float, kept: str, drawn: str) -> DataFrame:
        total = F.sum(available).over(everything)
        keep = total - F.ceil(total * F.lit(fraction))
        share = F.col(available) / total * keep
        by_remainder = Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), "stratum")
        return (
            table.withColumn("_keep", keep)
            .withColumn("_floor", F.floor(share))
            .withColumn("_rest", share - F.col("_floor"))
            .withColumn("_missing", F.col("_keep") - F.sum("_floor").over(everything))
            .withColumn("_place", F.row_number().over(by_remainder))
            .withColumn(kept, F.col("_floor") + (F.col("_place") <= F.col("_missing")).cast("bigint"))
            .withColumn(drawn, F.col(available) - F.col(kept))
            .drop("_keep", "_floor", "_rest", "_missing", "_place")
        )

    first = draw(counts, "n", test, "_rest_n", "n_test")
    second = draw(first, "_rest_n", validation / (train + validation), "n_train", "n_validation")
    return second.select("stratum", "n", "n_train", "n_validation", "n_test")


def validate_split(df: DataFrame, stratum: str, ratios: Sequence[float]) -> int:
    """Raise if no exact stratified split exists; return the number of classes."""
    check_ratios(*ratios)
    if stratum not in df.columns:
        raise KeyError(f"cannot stratify by {stratum!r}; columns are {df.columns}")
    train, validation, test = ratios
    row = (
        df.groupBy(stratum).agg(F.count("*").alias("n"))
        .agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.min("n").alias("least"))
        .first()
    )
    n, classes = row["n"] or 0, row["classes"]
    if n < 3:
        raise ValueError(f"need at least 3 rows to split, got {n}")
    if row["least"] < 2:
        raise ValueError("every class needs at least 2 rows")
    n_test = -int(-n * test // 1)
    n_validation = -int(-(n - n_test) * (validation / (train + validation)) // 1)
    if min(n_test, n_validation, n - n_test - n_validation) < classes:
        raise ValueError(f"a split of {n} rows would have fewer rows than the {classes} classes")
    return classes


def _cuts(keyed: DataFrame, positions: DataFrame, names: Sequence[str], classes: int) -> DataFrame:
    """For each stratum and named position, the (key, id) of the row at that 0-based rank.

    ``keyed`` has (_stratum, _key, _id); ``positions`` has (_stratum, names...). Only the rows of the
    buckets that hold a wanted position are ranked.
    """
    bucketed = R.with_hash_bucket(keyed, "_key", X.HASH_BITS)
    before = Window.partitionBy("_stratum").orderBy(R.BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        bucketed.groupBy("_stratum", R.BUCKET).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    )
    spots = totals.join(positions, "_stratum")

    def in_bucket(name: str) -> Column:
        return (F.col(name) >= F.col("_before")) & (F.col(name) < F.col("_before") + F.col("_n"))

    hit = in_bucket(names[0])
    for name in names[1:]:
        hit = hit | in_bucket(name)
    spots = spots.where(hit).select(
        "_stratum", R.BUCKET, *[F.when(in_bucket(n), F.col(n) - F.col("_before")).alias(n) for n in names]
    )
    inside = Window.partitionBy("_stratum", R.BUCKET).orderBy("_key", "_id")
    near = bucketed.join(_small(spots, classes), ["_stratum", R.BUCKET])
    ranked = near.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.groupBy("_stratum").agg(
        *[F.max(F.when(F.col("_rank") == F.col(n), F.struct("_key", "_id"))).alias(n) for n in names]
    )


def _small(table: DataFrame, classes: int) -> DataFrame:
    """Broadcast a table of a few rows per class, unless there are very many classes."""
    return F.broadcast(table) if classes <= BROADCAST_CLASSES else table


def _below(cut: str) -> Column:
    """Row lies before the cut; a missing cut lies after every row."""
    return F.coalesce(F.struct("_key", "_id") < F.col(cut), F.lit(True))


def stratified_split(
    df: DataFrame, stratum: str = "label", row_id: str = "row_id",
    ratios: Sequence[float] = (C.TRAIN_RATIO, C.VALIDATION_RATIO, C.TEST_RATIO), seed: int = C.SEED,
) -> DataFrame:
    """Add ``split``: exact quotas per class, membership fixed by (seed, row_id). Row ids must be unique.

    Rows of a class are ordered by a seeded hash; the first quota is test, the next validation. Instead
    of ranking all rows, the hash values at the two quota borders are found, and every row is then
    assigned by comparison: the table itself, texts included, is never shuffled.
    """
    classes = validate_split(df, stratum, ratios)
    keys = {"_stratum": F.struct(stratum), "_key": X.seeded_key(seed, row_id), "_id": F.col(row_id)}
    keyed = df.select(*[c.alias(n) for n, c in keys.items()])
    counts = keyed.groupBy(F.col("_stratum").alias("stratum")).agg(F.count("*").alias("n"))
    quotas = split_quotas(counts, ratios)
    borders = quotas.select(
        F.col("stratum").alias("_stratum"),
        F.col("n_test").alias("_test"),
        (F.col("n_test") + F.col("n_validation")).alias("_validation"),
    )
    cuts = _cuts(keyed, borders, ["_test", "_validation"], classes)
    split = F.when(_below("_test"), "test").when(_below("_validation"), "validation").otherwise("train")
    return (
        df.withColumns(keys)
        .join(_small(cuts, classes), "_stratum")
        .withColumn("split", split)
        .select(*[c for c in df.columns if c != "split"], "split")
    )


def subsample(df: DataFrame, n: int | None, seed: int = C.SEED, row_id: str = "row_id") -> DataFrame:
    """Exactly ``n`` seeded random rows; all rows if ``n`` is missing, not positive or too large.

    The n-th smallest hash is found and every row compared with it: no task gets the whole sample.
    """
    if n is None or n <= 0:
        return df
    keys = {"_key": X.seeded_key(seed, row_id), "_id": F.col(row_id)}
    keyed = df.select(F.lit(0).alias("_stratum"), *[c.alias(k) for k, c in keys.items()])
    spot = df.sparkSession.range(1).select(F.lit(0).alias("_stratum"), F.lit(n).cast("bigint").alias("_cut"))
    cut = _cuts(keyed, spot, ["_cut"], 1).select("_cut")  # no row if the table is smaller
    return df.withColumns({**keys, "_cut": cut.scalar()}).where(_below("_cut")).select(*df.columns)


def shuffle_epoch(df: DataFrame, epoch: int, seed: int = C.SEED, row_id: str = "row_id") -> DataFrame:
    """Add ``position``: the row's 0-based place in the random order of this epoch."""
    keyed = df.withColumn("_key", X.seeded_key(f"{seed}:{epoch}", row_id))
    return R.global_rank(keyed, "_key", [row_id], X.HASH_BITS, "position").drop("_key")
