"""Drill-down into wrong predictions.

Reports start from a narrow, stored table without texts; texts are fetched for the rows that are shown.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.functions import scoring as S
from quillmark.functions import text as X
from quillmark.operators import rank as R
from quillmark.session import stored


def align_predictions(predictions: DataFrame, snippets: DataFrame, row_id: str = "row_id", check: bool = True) -> DataFrame:
    """Predictions joined to their texts by key; raises if either side has rows the other lacks."""
    if check:
        # Ids and side markers only; one pass over both, counted before the shuffle.
        sides = predictions.select(row_id, F.lit(1).alias("p"), F.lit(0).alias("s")).unionAll(
            snippets.select(row_id, F.lit(0).alias("p"), F.lit(1).alias("s"))
        )
        per_id = sides.groupBy(row_id).agg(F.sum("p").alias("p"), F.sum("s").alias("s"))
        bad = per_id.where((F.col("p") != 1) | (F.col("s") != 1)).count()
        if bad:
            raise ValueError(f"{bad} row ids are not found exactly once in both predictions and snippets")
    extra = [c for c in snippets.columns if c == row_id or c not in predictions.columns]
    return predictions.join(snippets.select(*extra), row_id)


def error_table(df: DataFrame, code: str = "code") -> DataFrame:
    """Add the names, correctness, lengths and confidence that error reports show.

    Needs code, label, prediction, prob_ai.
    """
    return df.withColumns(
        {
            "label_name": X.label_name("label"),
            "prediction_name": X.label_name("prediction"),
            "is_correct": S.is_correct("label", "prediction"),
            "n_chars": X.n_chars(code),
            "n_lines": X.n_lines(code),
            "confidence": S.confidence("prob_ai", "prediction"),
        }
    )


_NARROW = ("label", "label_name", "prediction", "prediction_name", "prob_ai", "is_correct", "n_chars", "n_lines", "confidence")


@dataclass(frozen=True)
class ErrorTable:
    """Predictions with what error reports show, stored without texts, and where the texts are."""

    rows: DataFrame
    texts: DataFrame
    row_id: str = "row_id"

    def summary(self) -> DataFrame:
        return _summary(self.rows)

    def top(self, n: int | None = C.MAX_ERROR_ROWS) -> DataFrame:
        """The most confident errors, with their texts, in order; None: all of them."""
        wrong = errors_only(self.rows)
        if n is None:
            return wrong.join(self.texts, self.row_id).orderBy(*_order(self.row_id))
        first = stored(R.top_n(wrong, _order(self.row_id), self.row_id, n), "errors")
        small = F.broadcast(first) if n <= R.BROADCAST_IDS else first
        return self.texts.join(small, self.row_id).orderBy(*_order(self.row_id)).limit(n)


def error_rows(predictions: DataFrame, snippets: DataFrame, row_id: str = "row_id", code: str = "code") -> ErrorTable:
    """Predictions with their texts' lengths, joined once by key; raises if either side has rows the other lacks.

    Lengths are taken where the texts lie, so no text is shuffled. That every id is there once on both sides is then seen from the
    stored rows.
    """
    lengths = snippets.select(row_id, X.n_chars(code).alias("n_chars"), X.n_lines(code).alias("n_lines"), F.lit(1).alias("_text"))
    scored = predictions.select(row_id, "label", "prediction", "prob_ai", F.lit(1).alias("_scored"))
    both = scored.join(lengths, row_id, "full").withColumns(
        {
            "label_name": X.label_name("label"), "prediction_name": X.label_name("prediction"),
            "is_correct": S.is_correct("label", "prediction"), "confidence": S.confidence("prob_ai", "prediction"),
        }
    )
    rows = stored(both, "error-rows")
    whole = F.col("_text").isNotNull() & F.col("_scored").isNotNull()
    per_id = rows.groupBy(row_id).agg(F.count("*").alias("n"), F.bool_and(whole).alias("whole"))
    bad = per_id.where((F.col("n") != 1) | ~F.col("whole") | F.col(row_id).isNull()).count()
    if bad:
        raise ValueError(f"{bad} row ids are not found exactly once in both predictions and snippets")
    return ErrorTable(rows.select(row_id, *_NARROW), snippets.select(row_id, F.col(code).alias("code")), row_id)


def errors_only(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_correct"))


def correct_only(df: DataFrame) -> DataFrame:
    return df.where("is_correct")


def rank_errors(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Wrong rows, most confident first; ties by row id."""
    return errors_only(df).orderBy(*_order(row_id))


def _order(row_id: str) -> list[Column]:
    return [F.desc("confidence"), F.col(row_id)]


def top_errors(df: DataFrame, n: int = C.MAX_ERROR_ROWS, row_id: str = "row_id") -> DataFrame:
    """The report's first ``n`` wrong rows."""
    return R.top_n(errors_only(df), _order(row_id), row_id, n)


def error_summary(df: DataFrame) -> DataFrame:
    """One flat row over an `error_table`; statistics of an empty group are NULL. The table is read once."""
    return _summary(stored(df.select("label", "prediction", "is_correct", "confidence", "n_chars", "n_lines"), "errors"))


def _summary(df: DataFrame) -> DataFrame:
    wrong = ~F.col("is_correct")

    def mean(value: str, when: Column) -> Column:
        return F.avg(F.when(when, F.col(value)))

    totals = df.agg(
        F.count("*").alias("n_test"),
        F.count_if(wrong).alias("n_errors"),
        S.ratio(F.count_if(wrong), F.greatest(F.count("*"), F.lit(1))).alias("error_rate"),
        F.count_if(wrong & (F.col("label") == C.HUMAN)).alias("errors_true_human"),
        F.count_if(wrong & (F.col("label") == C.AI)).alias("errors_true_ai"),
        F.count_if(wrong & (F.col("prediction") == C.HUMAN)).alias("errors_predicted_human"),
        F.count_if(wrong & (F.col("prediction") == C.AI)).alias("errors_predicted_ai"),
        mean("confidence", wrong).alias("mean_confidence_on_errors"),
        mean("n_chars", wrong).alias("errors_n_chars_mean"),
        mean("n_chars", ~wrong).alias("correct_n_chars_mean"),
        mean("n_lines", wrong).alias("errors_n_lines_mean"),
        mean("n_lines", ~wrong).alias("correct_n_lines_mean"),
    )
    # Confidences are all but distinct, so their median is found on a distributed histogram.
    median = R.exact_quantiles(errors_only(df), "confidence", [0.5]).select("quantile")
    return totals.withColumn("median_confidence_on_errors", median.scalar())


def nested_summary(flat: DataFrame) -> DataFrame:
    """The flat summary in its stored shape."""
    human, ai = C.LABEL_NAMES[C.HUMAN], C.LABEL_NAMES[C.AI]

    def classes(kind: str) -> Column:
        return F.create_map(
            F.lit(human), F.col(f"errors_{kind}_human"), F.lit(ai), F.col(f"errors_{kind}_ai")
        )

    lengths = ("errors_n_chars_mean", "correct_n_chars_mean", "errors_n_lines_mean", "correct_n_lines_mean")
    return flat.select(
        "n_test",
        "n_errors",
        "error_rate",
        classes("true").alias("errors_by_true_class"),
        classes("predicted").alias("errors_by_predicted_class"),
        "mean_confidence_on_errors",
        "median_confidence_on_errors",
        F.struct(*lengths).alias("length_stats"),
    )
