"""Language filter, length filter, duplicate handling and their counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.functions import text as X
from quillmark.session import stored


def filter_language(df: DataFrame, languages: Sequence[str] = C.PYTHON_ALIASES, column: str = "language") -> DataFrame:
    """Rows whose canonical language is one of the aliases."""
    if column not in df.columns:
        raise KeyError(f"no column {column!r}; normalize the table first (columns: {df.columns})")
    return df.where(F.col(column).isin(*languages))


def long_enough(code: Column | str, min_length: int = C.MIN_CODE_LENGTH) -> Column:
    """True if the stripped text has ``min_length`` characters; false for a missing text."""
    return F.coalesce(F.length(X.strip(code)) >= min_length, F.lit(False))


def filter_min_length(df: DataFrame, min_length: int = C.MIN_CODE_LENGTH, code: str = "code") -> DataFrame:
    return df.where(long_enough(code, min_length))


def reject_blank(df: DataFrame, code: str = "code") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): rejected texts are missing or whitespace only."""
    filled = long_enough(code, 1)
    return df.where(filled), df.where(~filled)


def duplicate_count(df: DataFrame, code: str = "code") -> DataFrame:
    """One row: rows, distinct texts, and rows beyond the first of their text."""
    copies = df.groupBy(X.digest(code).alias("d")).agg(F.count("*").alias("n"))
    return copies.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_distinct"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"),
    )


def conflicting_labels(df: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    """One row: number of texts that occur with more than one label."""
    spread = df.groupBy(X.digest(code).alias("d")).agg(F.min(label).alias("lo"), F.max(label).alias("hi"))
    return spread.where(F.col("lo") != F.col("hi")).agg(F.count("*").alias("n_conflicting"))


#: Bits of the table of repeated digests, which every task gets (16 MiB), and of one of its rows.
TABLE_BITS, ROW_BITS = 27, 15


def _place(digest: Column) -> Column:
    """A digest's bit in the table."""
    return F.pmod(F.xxhash64(digest), F.lit(1 << TABLE_BITS))


def _repeated(digests: DataFrame) -> DataFrame:
    """(_row, _bits): the table, a bit for each digest that occurs twice; at most 4,096 rows of 4 KiB, whatever the data."""
    repeated = digests.groupBy("_digest").agg(F.count("*").alias("n")).where("n > 1").select(_place(F.col("_digest")).alias("p"))
    row, bit = F.shiftright("p", ROW_BITS).alias("_row"), F.pmod("p", F.lit(1 << ROW_BITS)).alias("bit")
    return repeated.select(row, bit).groupBy("_row").agg(F.bitmap_construct_agg("bit").alias("_bits"))


def _marked(df: DataFrame, code: str) -> DataFrame:
    """Add ``_digest``, and ``_maybe``: whether the text may have a copy. Only texts with one, and few others, are marked."""
    with_digest = df.withColumn("_digest", X.digest(code))
    table = stored(_repeated(with_digest.select("_digest")), "repeated")
    placed = with_digest.withColumn("_row", F.shiftright(_place(F.col("_digest")), ROW_BITS)).withColumn(
        "_bit", F.pmod(_place(F.col("_digest")), F.lit(1 << ROW_BITS))
    )
    both = placed.join(F.broadcast(table), "_row", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1
    return both.select(*df.columns, "_digest", F.coalesce(held, F.lit(False)).alias("_maybe"))


def dedup_keep_first(df: DataFrame, order: Sequence[str] = ("row_id",), code: str = "code") -> DataFrame:
    """Of all rows with exactly the same text, the one lowest in ``order``.

    Digests alone are counted first; a table of fixed size then tells a row in place that its text has no copy, and such rows go
    through as they are. Only the others are shuffled, by digest, after ranking to 1 inside each map task: a group of copies of any
    size sends at most one row per task. ``df`` is read three times, so it should be a stored table or narrow steps on one.
    """
    marked = _marked(df, code)
    first = Window.partitionBy("_digest").orderBy(*order)
    copies = marked.where("_maybe").withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") == 1)
    return marked.where("NOT _maybe").select(*df.columns).unionByName(copies.select(*df.columns))


def clean(df: DataFrame, min_length: int = C.MIN_CODE_LENGTH, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Length filter, then exact de-duplication."""
    return dedup_keep_first(filter_min_length(df, min_length), order)


def stage_retention(
    df: DataFrame, languages: Sequence[str] = C.PYTHON_ALIASES, min_length: int = C.MIN_CODE_LENGTH,
    code: str = "code", language: str = "language", label: str = "label",
) -> DataFrame:
    """One row with what each cleaning stage keeps and drops, and the conflicts, from one scan.

    Texts are pre-counted by digest, so counts merge before the shuffle and no set of digests is held in
    one task.
    """
    in_language = F.coalesce(F.col(language).isin(*languages), F.lit(False))
    kept = in_language & long_enough(code, min_length)
    by_text = df.groupBy(F.when(kept, X.digest(code)).alias("d")).agg(
        F.count("*").alias("n"),
        F.count_if(in_language).alias("n_language"),
        F.count_if(kept).alias("n_kept"),
        F.min(F.when(kept, F.col(label))).alias("lo"),
        F.max(F.when(kept, F.col(label))).alias("hi"),
    )
    zero = F.lit(0)
    total = F.coalesce(F.sum("n"), zero)
    lang_n = F.coalesce(F.sum("n_language"), zero)
    long_n = F.coalesce(F.sum("n_kept"), zero)
    distinct = F.count_if(F.col("d").isNotNull())
    return by_text.agg(
        total.alias("n_total"),
        lang_n.alias("n_language"),
        (100.0 * lang_n / F.greatest(total, F.lit(1))).alias("language_pct"),
        (lang_n - long_n).alias("dropped_short"),
        (long_n - distinct).alias("dropped_duplicates"),
        distinct.alias("n_clean"),
        F.count_if(F.col("lo") != F.col("hi")).alias("n_conflicting"),
    )
