"""Padded mini-batches of encoded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.functions import text as X
from quillmark.operators import rank as R


def batch_plan(
    df: DataFrame, batch_size: int = C.BATCH_SIZE, epoch: int = 0, seed: int = C.SEED,
    row_id: str = "row_id", length: str = "n_tokens",
) -> DataFrame:
    """(row_id, batch_id, slot, pad_to): consecutive groups of the epoch's order and their longest row.

    Works on ids and lengths only; the token arrays join in once, in `assemble_batches`.
    """
    keyed = df.select(row_id, F.col(length).alias("_len"), X.seeded_key(f"{seed}:{epoch}", row_id).alias("_key"))
    ranked = R.global_rank(keyed, "_key", [row_id], X.HASH_BITS, "_rank")
    batch = F.floor(F.col("_rank") / batch_size).cast("bigint")
    longest = F.max("_len").over(Window.partitionBy("batch_id"))  # batch_size rows each
    return (
        ranked.withColumn("batch_id", batch)
        .withColumn("slot", (F.col("_rank") % batch_size).cast("int"))
        .withColumn("pad_to", longest)
        .select(row_id, "batch_id", "slot", "pad_to")
    )


def assemble_batches(
    encoded: DataFrame, batch_size: int = C.BATCH_SIZE, epoch: int = 0, seed: int = C.SEED,
    row_id: str = "row_id", pad_id: int = C.PAD_ID,
) -> DataFrame:
    """Every row padded to the longest of its batch; the mask is 0 on padding."""
    sized = encoded.withColumn("n_tokens", F.size("input_ids"))
    plan = batch_plan(sized, batch_size, epoch, seed, row_id)
    gap = F.col("pad_to") - F.size("input_ids")
    return encoded.join(plan, row_id).select(
        "batch_id",
        "slot",
        row_id,
        "label",
        F.concat("input_ids", F.array_repeat(F.lit(pad_id), gap)).alias("input_ids"),
        F.concat("attention_mask", F.array_repeat(F.lit(0).cast("tinyint"), gap)).alias("attention_mask"),
    )
