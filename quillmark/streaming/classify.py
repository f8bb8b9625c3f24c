"""Scoring of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quillmark import constants as C
from quillmark.operators import clean as CL
from quillmark.operators import model as MO

SNIPPET_SCHEMA = T.StructType(
    [T.StructField("row_id", T.LongType()), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType())]
)


def classify_stream(
    spark: SparkSession, in_dir: str, model: MO.Predictor, out_dir: str, checkpoint_dir: str,
    threshold: float = C.THRESHOLD, fmt: str = "parquet", schema: T.StructType = SNIPPET_SCHEMA,
    max_files_per_trigger: int | None = None, max_tokens: int = C.MAX_TOKENS, rejects_dir: str | None = None,
) -> StreamingQuery:
    """Start a query that judges every row of new files and stops when none is left.

    Verdicts go to ``out_dir``; missing and blank texts, which the batch rejects too, to ``rejects_dir`` with a reason (nowhere, if
    not given). Both tables are Parquet, a folder ``batch_id=...`` for each micro-batch. A batch that is run again after a failure
    replaces its own folders, so every input row counts exactly once in each table.
    """
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def judge(rows: DataFrame, batch_id: int) -> None:
        write_batch(rows, batch_id, model, out_dir, threshold, max_tokens, rejects_dir)

    return (
        reader.load(in_dir).writeStream.foreachBatch(judge)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )


def write_batch(
    rows: DataFrame, batch_id: int, model: MO.Predictor, out_dir: str, threshold: float = C.THRESHOLD,
    max_tokens: int = C.MAX_TOKENS, rejects_dir: str | None = None,
) -> None:
    """Verdicts and rejects of one micro-batch, in place of what an earlier try of the same batch has written."""
    accepted, rejected = CL.reject_blank(rows)
    MO.verdicts(accepted, model, threshold, max_tokens).write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}")
    if rejects_dir:
        reasons = rejected.withColumn("reason", F.lit("empty or whitespace only"))
        reasons.write.mode("overwrite").parquet(f"{rejects_dir}/batch_id={batch_id}")
