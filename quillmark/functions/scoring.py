"""Column expressions over scores and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.functions.text import _col

_EPS = 1e-15


def sigmoid(logit: Column | str) -> Column:
    return 1.0 / (1.0 + F.exp(-_col(logit)))


def hard_prediction(prob: Column | str, threshold: float | Column = C.THRESHOLD) -> Column:
    """1 if the probability reaches the threshold. Inclusive, unlike MLlib's own prediction."""
    return (_col(prob) >= threshold).cast("int")


def confidence(prob: Column | str, prediction: Column | str) -> Column:
    """Probability given to the class that was predicted."""
    return F.when(_col(prediction) == C.AI, _col(prob)).otherwise(1.0 - _col(prob))


def shown_confidence(prob: Column | str) -> Column:
    """Confidence shown with a verdict: the larger of both probabilities."""
    return F.greatest(_col(prob), 1.0 - _col(prob))


def is_correct(label: Column | str, prediction: Column | str) -> Column:
    return _col(label) == _col(prediction)


def bce_from_logit(logit: Column | str, label: Column | str) -> Column:
    """Per-row binary cross entropy, stable for large logits."""
    x, y = _col(logit), _col(label)
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def bce_from_prob(prob: Column | str, label: Column | str) -> Column:
    p = F.least(F.greatest(_col(prob), F.lit(_EPS)), F.lit(1.0 - _EPS))
    return -F.when(_col(label) == C.AI, F.ln(p)).otherwise(F.ln(1.0 - p))


def ratio(num: Column, den: Column) -> Column:
    """num/den, with 0/0 and x/0 giving 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))
