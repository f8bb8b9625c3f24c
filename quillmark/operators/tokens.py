"""Token arrays, vocabulary and ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.functions import text as X
from quillmark.operators.spread import attach
from quillmark.session import stored

VOCABULARY = 50_000
#: Tokens that are looked up in place: all of a vocabulary up to this size, the most frequent ones of a larger one.
IN_PLACE = 1 << 18
_SLOTS = 1 << 16


def tokenize(df: DataFrame, max_length: int = C.MAX_TOKENS, code: str = "code") -> DataFrame:
    """Add ``tokens``, cut from the tail to leave room for the two marks, and ``n_tokens`` with them."""
    room = max_length - 2
    if room < 0:
        raise ValueError("max_length must be at least 2")
    cut = df.withColumn("tokens", F.slice(X.tokens(code), 1, room))
    return cut.withColumn("n_tokens", F.size("tokens") + 2)


def build_vocab(df: DataFrame, size: int = VOCABULARY, code: str = "code") -> DataFrame:
    """(token, n, token_id) of the most frequent tokens over whole texts; ties by token."""
    counts = df.select(F.explode(X.tokens(code)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    # The count that the last token kept has. Distinct counts are few: at most the root of twice the tokens.
    sizes = counts.groupBy("n").agg(F.count("*").alias("k"))
    above = Window.partitionBy(F.lit(0)).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    more = sizes.withColumn("above", F.coalesce(F.sum("k").over(above), F.lit(0)))
    least = more.where(F.col("above") < size).agg(F.min("n"))
    top = counts.where(F.col("n") >= least.scalar()).orderBy(F.desc("n"), "token").limit(size)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token"))  # `size` rows at most
    return top.withColumn("token_id", (place - 1 + C.FIRST_TOKEN_ID).cast("int"))


def _lookup(vocab: DataFrame) -> DataFrame:
    """One row: an array of small maps token -> id, the token's hash choosing the map."""
    slot = F.pmod(F.xxhash64("token"), F.lit(_SLOTS)).alias("slot")
    entries = vocab.groupBy(slot).agg(F.collect_list(F.struct("token", "token_id")).alias("entries"))
    full = vocab.sparkSession.range(_SLOTS).withColumnRenamed("id", "slot").join(entries, "slot", "left")
    ordered = F.sort_array(F.collect_list(F.struct("slot", "entries")))
    return full.agg(F.transform(ordered, lambda s: F.map_from_entries(s["entries"])).alias("slots"))


def _in_place(slots: Column, token: Column) -> Column:
    """The token's id, NULL if the table of `_lookup` hasn't it."""
    ids = F.get(slots, F.pmod(F.xxhash64(token), F.lit(_SLOTS)).cast("int"))
    return F.try_element_at(ids, token)


def _framed(ids: Column) -> Column:
    return F.concat(F.array(F.lit(C.BEGIN_ID)), ids, F.array(F.lit(C.END_ID)))


def _with_mask(df: DataFrame) -> DataFrame:
    return df.withColumn("attention_mask", F.array_repeat(F.lit(1).cast("tinyint"), F.size("input_ids")))


def encode_ids(df: DataFrame, vocab: DataFrame, row_id: str = "row_id", in_place: int = IN_PLACE) -> DataFrame:
    """Add ``input_ids`` (begin, ids, end) and ``attention_mask`` to a table with ``tokens``.

    Ids of up to ``in_place`` tokens are looked up in place in a hashed table sent to every task, so rows are neither exploded nor
    regrouped, and nothing is shuffled. Of a larger vocabulary its first tokens are, the most frequent ones; see `_by_join` for the
    others, which needs a unique ``row_id``.
    """
    if vocab.count() > in_place:
        return _by_join(df, vocab, row_id, in_place)
    ids = F.transform("tokens", lambda t: F.coalesce(_in_place(F.col("_slots"), t), F.lit(C.UNKNOWN_ID)))
    looked = df.withColumn("_slots", _lookup(vocab).scalar()).withColumn("input_ids", _framed(ids)).drop("_slots")
    return _with_mask(looked)


def _by_join(df: DataFrame, vocab: DataFrame, row_id: str, in_place: int) -> DataFrame:
    """The same ids from a vocabulary of any size.

    What the table of frequent tokens doesn't hold is joined to the rest of the vocabulary by token, each token of a row once. Tokens
    that many rows have although the vocabulary gives them a late place, or none, are dealt over several tasks. Ids come back as a
    map for each row.
    """
    if row_id not in df.columns:
        raise KeyError(f"a vocabulary of more than {in_place} tokens needs rows with a unique {row_id!r}")
    border = C.FIRST_TOKEN_ID + in_place
    first, rest = vocab.where(F.col("token_id") < border), vocab.where(F.col("token_id") >= border)
    slots = _lookup(first).scalar()
    missing = F.array_distinct(F.filter("tokens", lambda t: _in_place(F.col("_slots"), t).isNull()))
    asked = df.select(row_id, "tokens").withColumn("_slots", slots).select(row_id, F.explode(missing).alias("token"))
    found = attach(stored(asked, "tokens"), rest.select("token", "token_id"), "token", how="inner")
    per_row = found.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("token", "token_id"))).alias("_rare"))
    both = df.join(per_row, row_id, "left").withColumn("_slots", slots)
    ids = F.transform(
        "tokens",
        lambda t: F.coalesce(_in_place(F.col("_slots"), t), F.try_element_at("_rare", t), F.lit(C.UNKNOWN_ID)),
    )
    return _with_mask(both.withColumn("input_ids", _framed(ids)).drop("_slots", "_rare"))


def keep_token_columns(df: DataFrame, extra: Sequence[str] = ("row_id",)) -> DataFrame:
    """Ids, mask and label (and the row key); raises if one is missing."""
    wanted = [*extra, "input_ids", "attention_mask", "label"]
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"tokenized table lacks {missing}")
    return df.select(*wanted)


def token_length_summary(df: DataFrame, max_length: int = C.MAX_TOKENS, by: str = "split", length: str = "n_tokens") -> DataFrame:
    """Length statistics per split; ``truncated_pct`` is the share at the actual limit."""
    counts = df.groupBy(by, F.col(length).alias("v")).agg(F.count("*").alias("n"))
    n, v = F.col("n"), F.col("v")
    return counts.groupBy(by).agg(
        F.sum(n).alias("count"),
        (F.sum(n * v) / F.sum(n)).alias("mean"),
        F.min(v).alias("min"),
        F.percentile(v, 0.5, n).alias("p50"),
        F.percentile(v, 0.95, n).alias("p95"),
        F.percentile(v, 0.99, n).alias("p99"),
        F.max(v).alias("max"),
        (100.0 * F.sum(F.when(v >= max_length, n).otherwise(0)) / F.sum(n)).alias("truncated_pct"),
    )
