"""Classification measures over a predictions table (row_id, label, prob_ai, prediction).

Rank measures start from a `Scores` table: how many rows of each class have each score. It is exact, stored, and can be merged
with others, so predictions are read once for any number of reports. A function that is given predictions makes one for itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.functions import scoring as S
from quillmark.operators import rank as R
from quillmark.session import stored

CLASS_NAMES = (C.LABEL_NAMES[C.HUMAN], C.LABEL_NAMES[C.AI])


@dataclass(frozen=True)
class Scores:
    """(by..., prob, pos, neg, other), stored: rows of label 1, of label 0, and of any other or none, for each score."""

    table: DataFrame
    by: tuple[str, ...] = ()

    @cached_property
    def edges(self) -> list[float]:
        """Where to cut the scores into buckets; taken from the table, whatever made it."""
        return R.split_points(self.table, "prob")


#: What measures are computed from.
Measured = DataFrame | Scores
_COUNTS = ("pos", "neg", "other")


def score_table(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str = "prob_ai", overall: str | None = None
) -> Scores:
    """Count the scores of predictions, in one pass over them. Counts merge before the shuffle.

    With ``overall`` the single group column also gets a group of that name, over all rows: a second grouping of the counted
    scores, not of the predictions.
    """
    ai, human = F.col(label) == C.AI, F.col(label) == C.HUMAN
    known = F.coalesce(ai | human, F.lit(False))
    counted = df.groupBy(*by, F.col(prob).alias("prob")).agg(
        F.count_if(ai).alias("pos"), F.count_if(human).alias("neg"), F.count_if(~known).alias("other")
    )
    scores = Scores(stored(counted, "scores"), tuple(by))
    return scores if overall is None else with_overall(scores, overall)


def with_overall(scores: Scores, name: str) -> Scores:
    """The same scores by their group and, as group ``name``, all together."""
    (group,) = scores.by
    if scores.table.schema[group].dataType.simpleString() != "string":
        raise TypeError(f"the group column {group!r} must be text to hold {name!r}")
    taken = scores.table.groupingSets([[F.col(group), F.col("prob")], [F.col("prob")]], F.col(group), F.col("prob"))
    summed = taken.agg(*[F.sum(c).alias(c) for c in _COUNTS], F.grouping(F.col(group)).alias("_all"))
    named = summed.withColumn(group, F.when(F.col("_all") == 1, F.lit(name)).otherwise(F.col(group)))
    return Scores(stored(named.drop("_all"), "scores"), scores.by)


def merge_scores(tables: Sequence[Scores]) -> Scores:
    """Scores of several runs or parts together, as if their predictions had been counted at once."""
    if len({t.by for t in tables}) != 1:
        raise ValueError("only scores of the same groups can be merged")
    united = reduce(DataFrame.unionByName, [t.table for t in tables])
    summed = united.groupBy(*tables[0].by, "prob").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    return Scores(stored(summed, "scores"), tables[0].by)


def _scores(df: Measured, by: Sequence[str], label: str, prob: str) -> Scores:
    if isinstance(df, Scores):
        if by and tuple(by) != df.by:
            raise ValueError(f"these scores are grouped by {df.by}, not by {tuple(by)}")
        return df
    return score_table(df, by, label, prob)


def validate_predictions(df: Measured, label: str = "label", prob: str = "prob_ai") -> None:
    """Raise on an empty table, missing values, labels other than 0/1, or only one class."""
    scores = df if isinstance(df, Scores) else score_table(df.select(label, prob), (), label, prob)
    lost = F.col("prob").isNull() | F.isnan("prob")
    rows = F.col("pos") + F.col("neg") + F.col("other")
    row = scores.table.agg(
        F.sum(rows).alias("n"), F.sum(F.when(lost, rows).otherwise(0)).alias("missing"), F.sum("other").alias("other"),
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
    ).first()
    if not row["n"]:
        raise ValueError("no predictions to measure")
    if row["missing"]:
        raise ValueError(f"{row['missing']} rows lack a probability")
    if row["other"]:
        raise ValueError(f"{row['other']} labels are missing or neither 0 nor 1")
    if not row["pos"] or not row["neg"]:
        raise ValueError("AUC is undefined with only one class")


def with_prediction(df: DataFrame, threshold: float = C.THRESHOLD, prob: str = "prob_ai") -> DataFrame:
    return df.withColumn("prediction", S.hard_prediction(prob, threshold))


def _ranked(scores: Scores) -> DataFrame:
    """Scores with the positives and negatives that score lower, and the group totals."""
    bucketed = R.with_bucket(scores.table, "prob", scores.edges)
    return R.prefix_sums(bucketed, ["prob"], {"pos_below": "pos", "neg_below": "neg"}, scores.by)


def _matrix_counts(threshold: float) -> dict[str, Column]:
    """Counts over a score histogram: true class by predicted class."""
    above = F.col("prob") >= threshold
    zero = F.lit(0)
    return {
        "tn": F.sum(F.when(~above, F.col("neg")).otherwise(zero)).cast("bigint"),
        "fp": F.sum(F.when(above, F.col("neg")).otherwise(zero)).cast("bigint"),
        "fn": F.sum(F.when(~above, F.col("pos")).otherwise(zero)).cast("bigint"),
        "tp": F.sum(F.when(above, F.col("pos")).otherwise(zero)).cast("bigint"),
    }


def _measures() -> dict[str, Column]:
    """Measures from the four matrix counts; every 0/0 is 0."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    f1_h, f1_a = S.ratio(2 * tn, 2 * tn + fn + fp), S.ratio(2 * tp, 2 * tp + fp + fn)
    return {
        "accuracy": S.ratio(tn + tp, n),
        "macro_f1": (f1_h + f1_a) / 2,
        "precision_human": S.ratio(tn, tn + fn),
        "recall_human": S.ratio(tn, tn + fp),
        "f1_human": f1_h,
        "support_human": tn + fp,
        "precision_ai": S.ratio(tp, tp + fp),
        "recall_ai": S.ratio(tp, tp + fn),
        "f1_ai": f1_a,
        "support_ai": fn + tp,
        "n_samples": n,
    }


def matrix_counts(df: Measured, threshold: float = C.THRESHOLD, by: Sequence[str] = (), label: str = "label",
                  prob: str = "prob_ai") -> DataFrame:
    """One row (per group): tn, fp, fn, tp."""
    if isinstance(df, Scores):
        scores = _scores(df, by, label, prob)
        return scores.table.groupBy(*scores.by).agg(*[c.alias(n) for n, c in _matrix_counts(threshold).items()])
    above = F.col(prob) >= threshold
    human, ai = F.col(label) == C.HUMAN, F.col(label) == C.AI
    return df.groupBy(*by).agg(
        F.count_if(human & ~above).alias("tn"),
        F.count_if(human & above).alias("fp"),
        F.count_if(ai & ~above).alias("fn"),
        F.count_if(ai & above).alias("tp"),
    )


def _by(df: Measured, by: Sequence[str]) -> list[str]:
    return list(df.by if isinstance(df, Scores) else by)


def confusion_matrix(df: Measured, threshold: float = C.THRESHOLD, by: Sequence[str] = (), **cols: str) -> DataFrame:
    """Four rows (per group): true class, predicted class, n, and n as a share of the true class."""
    by = _by(df, by)
    counts = matrix_counts(df, threshold, by, **cols)
    cells = F.stack(
        F.lit(4),
        F.lit(0), F.lit(0), F.col("tn"), F.col("tn") + F.col("fp"),
        F.lit(0), F.lit(1), F.col("fp"), F.col("tn") + F.col("fp"),
        F.lit(1), F.lit(0), F.col("fn"), F.col("fn") + F.col("tp"),
        F.lit(1), F.lit(1), F.col("tp"), F.col("fn") + F.col("tp"),
    ).alias("label", "prediction", "n", "_row")
    return counts.select(*by, cells).select(
        *by, "label", "prediction", "n", S.ratio(F.col("n"), F.col("_row")).alias("share")
    )


def accuracy(df: Measured, threshold: float = C.THRESHOLD, by: Sequence[str] = (), **cols: str) -> DataFrame:
    by = _by(df, by)
    return matrix_counts(df, threshold, by, **cols).select(*by, _measures()["accuracy"].alias("accuracy"))


def _two_names(names: Sequence[str]) -> tuple[str, str]:
    if len(names) != 2:
        raise ValueError(f"two class names are needed, for 0 and for 1; got {list(names)}")
    return names[0], names[1]


def per_class_prf(
    df: Measured, threshold: float = C.THRESHOLD, by: Sequence[str] = (), names: Sequence[str] = CLASS_NAMES, **cols: str
) -> DataFrame:
    """One row per class: precision, recall, f1, support."""
    by = _by(df, by)
    human, ai = _two_names(names)
    m = _measures()
    wide = matrix_counts(df, threshold, by, **cols).select(*by, *[c.alias(n) for n, c in m.items()])
    fields = ("precision", "recall", "f1", "support")
    cells = F.stack(
        F.lit(2),
        F.lit(human), *[F.col(f"{f}_human") for f in fields],
        F.lit(ai), *[F.col(f"{f}_ai") for f in fields],
    ).alias("label_name", *fields)
    return wide.select(*by, cells)


def macro_f1(df: Measured, threshold: float = C.THRESHOLD, by: Sequence[str] = (), **cols: str) -> DataFrame:
    by = _by(df, by)
    return matrix_counts(df, threshold, by, **cols).select(*by, _measures()["macro_f1"].alias("macro_f1"))


def _auc() -> Column:
    """Share of (positive, negative) pairs in order, ties half, over a ranked histogram."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    ordered = F.sum(pos * (F.col("neg_below") + neg / 2))
    pairs = F.max("pos_below_total").cast("double") * F.max("neg_below_total").cast("double")
    return F.try_divide(ordered, pairs)


def auc_roc(df: Measured, by: Sequence[str] = (), label: str = "label", prob: str = "prob_ai") -> DataFrame:
    """Exact area under the ROC curve; NULL where only one class occurs."""
    scores = _scores(df, by, label, prob)
    return _ranked(scores).groupBy(*scores.by).agg(_auc().alias("auc_roc"))


def metric_bundle(
    df: Measured, threshold: float = C.THRESHOLD, by: Sequence[str] = (), label: str = "label", prob: str = "prob_ai"
) -> DataFrame:
    """All measures as one flat row (per group), from one table of scores."""
    scores = _scores(df, by, label, prob)
    by = scores.by
    counts = _ranked(scores).groupBy(*by).agg(
        *[c.alias(n) for n, c in _matrix_counts(threshold).items()], _auc().alias("auc_roc")
    )
    m = _measures()
    return counts.select(
        *by,
        m["accuracy"].alias("accuracy"),
        m["macro_f1"].alias("macro_f1"),
        "auc_roc",
        *[m[n].alias(n) for n in m if n not in ("accuracy", "macro_f1", "n_samples")],
        "tn", "fp", "fn", "tp",
        F.lit(float(threshold)).alias("threshold"),
        m["n_samples"].alias("n_samples"),
    )


def nested_bundle(flat: DataFrame, by: Sequence[str] = (), names: Sequence[str] = CLASS_NAMES) -> DataFrame:
    """The flat bundle in its stored shape: per-class map, 2x2 matrix, support map."""

    def cls(name: str) -> Column:
        return F.struct(*[F.col(f"{f}_{name}").alias(f) for f in ("precision", "recall", "f1", "support")])

    human, ai = _two_names(names)
    return flat.select(
        *by,
        "accuracy",
        "macro_f1",
        "auc_roc",
        F.create_map(F.lit(human), cls("human"), F.lit(ai), cls("ai")).alias("per_class"),
        F.array(F.array("tn", "fp"), F.array("fn", "tp")).alias("confusion_matrix"),
        F.create_map(F.lit(human), F.col("support_human"), F.lit(ai), F.col("support_ai")).alias("support"),
        "threshold",
        "n_samples",
    )


# --- Fixed values: row names of the report table ----------------------------
REPORT_ROWS = {
    "Accuracy": "accuracy",
    "Macro F1": "macro_f1",
    "AUC-ROC": "auc_roc",
    "Precision (human)": "precision_human",
    "Recall (human)": "recall_human",
    "F1 (human)": "f1_human",
    "Precision (ai)": "precision_ai",
    "Recall (ai)": "recall_ai",
    "F1 (ai)": "f1_ai",
}


def metrics_to_long(flat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Nine (metric, value, shown) rows per bundle; a missing value is shown as ``TBD``."""
    cells = [x for name, col in REPORT_ROWS.items() for x in (F.lit(name), F.col(col).cast("double"))]
    long = flat.select(*by, F.stack(F.lit(len(REPORT_ROWS)), *cells).alias("metric", "value"))
    shown = F.coalesce(F.format_string("%.4f", F.col("value")), F.lit("TBD"))
    return long.withColumn("shown", F.when(F.col("value").isNull(), "TBD").otherwise(shown))


def class_bars(prf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Long (class, measure, score) table of `per_class_prf`."""
    return prf.unpivot([*by, "label_name"], ["precision", "recall", "f1"], "measure", "score")


def roc_curve(
    df: Measured, by: Sequence[str] = (), label: str = "label", prob: str = "prob_ai", drop_collinear: bool = False
) -> DataFrame:
    """(threshold, fpr, tpr), one point per distinct score and the origin (threshold +inf).

    ``drop_collinear`` leaves out points inside a straight run: those whose next lower score adds the
    same numbers of positives and negatives. The first and the last score always stay.
    """
    scores = _scores(df, by, label, prob)
    by = list(scores.by)
    ranked = _ranked(scores)
    tp = F.col("pos_below_total") - F.col("pos_below")
    fp = F.col("neg_below_total") - F.col("neg_below")
    points = ranked.select(
        *by,
        F.col("prob").alias("threshold"),
        F.try_divide(fp.cast("double"), F.col("neg_below_total").cast("double")).alias("fpr"),
        F.try_divide(tp.cast("double"), F.col("pos_below_total").cast("double")).alias("tpr"),
        "pos", "neg",
    )
    if drop_collinear:
        points = _corners(points, by, scores.edges)
    points = points.select(*by, "threshold", "fpr", "tpr")
    start = scores.table.select(*by).distinct() if by else scores.table.sparkSession.range(1).select()
    origin = start.select(*by, F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def _corners(points: DataFrame, by: Sequence[str], edges: Sequence[float]) -> DataFrame:
    """Keep a point unless the next lower score has the same counts; neighbours across bucket borders
    come from a table with one row per bucket."""
    bucketed = R.with_bucket(points, "threshold", edges)
    bucketed = bucketed.withColumn("_g", F.struct(*by) if by else F.lit(0))
    here = F.struct("pos", "neg")
    edges = bucketed.groupBy("_g", R.BUCKET).agg(F.max_by(here, "threshold").alias("_top"), F.max("threshold").alias("_max"))
    group = Window.partitionBy("_g").orderBy(R.BUCKET)
    edges = edges.select(
        F.col("_g").alias("_e_g"),
        F.col(R.BUCKET).alias("_e_bucket"),
        F.lag("_top").over(group).alias("_below_edge"),
        F.max("_max").over(Window.partitionBy("_g")).alias("_highest"),
    )
    inside = Window.partitionBy("_g", R.BUCKET).orderBy("threshold")
    near = bucketed.withColumn("_below_here", F.lag(here).over(inside))
    joined = near.join(edges, (F.col("_g") == F.col("_e_g")) & (F.col(R.BUCKET) == F.col("_e_bucket")))
    below = F.coalesce("_below_here", "_below_edge")
    keep = below.isNull() | (below != here) | (F.col("threshold") == F.col("_highest"))
    return joined.where(keep).select(*points.columns)


def mean_bce_loss(
    df: DataFrame, by: Sequence[str] = (), label: str = "label", prob: str | None = "prob_ai", logit: str | None = None
) -> DataFrame:
    """Mean binary cross entropy over rows, from logits if given, else from clipped probabilities."""
    loss = S.bce_from_logit(logit, label) if logit else S.bce_from_prob(prob, label)
    return df.groupBy(*by).agg(F.avg(loss).alias("loss"), F.count("*").alias("n"))
