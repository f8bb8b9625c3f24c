"""Best epoch, early stop and curves from training histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import constants as C


def early_stop(
    history: DataFrame, patience: int = C.PATIENCE, run: str = "run_id", tolerance: float = C.MIN_IMPROVEMENT
) -> DataFrame:
    """Per run: best epoch and loss, epoch at which training stops, epochs that ran.

    An epoch improves if its loss is below the best so far by more than the tolerance; ``patience``
    epochs without improvement stop the run and later rows do not count. The state depends on the path,
    so it is folded over the run's epochs in order.
    """
    state = F.struct(
        F.lit(float("inf")).alias("best"),
        F.lit(0).cast("int").alias("best_epoch"),
        F.lit(0).cast("int").alias("bad"),
        F.lit(0).cast("int").alias("last"),
        F.lit(False).alias("stopped"),
    )

    def step(s, e):
        better = e["loss"] < s["best"] - tolerance
        bad = F.when(better, 0).otherwise(s["bad"] + 1).cast("int")
        advanced = F.struct(
            F.when(better, e["loss"]).otherwise(s["best"]).alias("best"),
            F.when(better, e["epoch"]).otherwise(s["best_epoch"]).cast("int").alias("best_epoch"),
            bad.alias("bad"),
            e["epoch"].alias("last"),
            (bad >= patience).alias("stopped"),
        )
        return F.when(s["stopped"], s).otherwise(advanced)

    epochs = F.array_sort(
        F.collect_list(F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("val_loss").cast("double").alias("loss")))
    )
    folded = history.groupBy(run).agg(F.aggregate(epochs, state, step).alias("s"))
    return folded.select(
        run,
        F.col("s.best_epoch").alias("best_epoch"),
        F.col("s.best").alias("best_val_loss"),
        F.col("s.last").alias("last_epoch"),
        F.col("s.stopped").alias("stopped_early"),
    )


def training_curves(history: DataFrame) -> DataFrame:
    """Loss and validation measures per epoch."""
    return history.select(
        "run_id",
        "epoch",
        "train_loss",
        "val_loss",
        F.col("val_metrics.accuracy").alias("val_accuracy"),
        F.col("val_metrics.macro_f1").alias("val_macro_f1"),
        F.col("val_metrics.auc_roc").alias("val_auc_roc"),
    ).orderBy("run_id", "epoch")
