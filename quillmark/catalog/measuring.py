"""Registered queries: scores, classification measures, errors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.catalog import base as B
from quillmark.functions import scoring as S
from quillmark.operators import errors as E
from quillmark.operators import metrics as M

_HIST = "h AS (SELECT prob_ai AS prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM preds GROUP BY prob_ai)"
_AUC = """
c AS (SELECT *, sum(neg) OVER (ORDER BY prob) - neg AS below, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM h),
auc AS (SELECT sum(pos * (below + neg / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)) AS auc_roc FROM c)"""
_MATRIX = """
m AS (SELECT count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp,
             count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 1 AND prediction = 1) AS tp FROM preds)"""
_MEASURES = """
r AS (SELECT *, (tn + tp)::DOUBLE / (tn + fp + fn + tp) AS accuracy,
  coalesce(tn::DOUBLE / nullif(tn + fn, 0), 0) AS precision_human, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS recall_human,
  coalesce(2 * tn::DOUBLE / nullif(2 * tn + fn + fp, 0), 0) AS f1_human, tn + fp AS support_human,
  coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision_ai, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall_ai,
  coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1_ai, fn + tp AS support_ai FROM m)"""
_ERRORS = f"""{B.PREDS},
errs AS (SELECT *, CASE label WHEN 0 THEN 'human' ELSE 'ai' END AS label_name,
  CASE prediction WHEN 0 THEN 'human' ELSE 'ai' END AS prediction_name, label = prediction AS is_correct,
  length(code)::BIGINT AS n_chars, (length(code) - length(replace(code, chr(10), '')) + 1)::BIGINT AS n_lines,
  CASE prediction WHEN 1 THEN prob_ai ELSE 1.0 - prob_ai END AS confidence FROM preds)"""
_RATES = ("accuracy", "macro_f1", "auc_roc", "precision_human", "recall_human", "f1_human", "precision_ai", "recall_ai", "f1_ai")


def _errors(spark, sf_dir):
    return E.error_table(B.predictions(spark, sf_dir))


@B.register("hard_prediction", f"WITH {B.PREDS} SELECT row_id, prediction FROM preds")
def hard_prediction(spark, sf_dir):
    return M.with_prediction(B.predictions(spark, sf_dir)).select("row_id", "prediction")


@B.register("sigmoid_prob", """
SELECT vec_id, round(1 / (1 + exp(-(embedding[1]::DOUBLE))), 6) AS prob_ai,
       round(1 - 1 / (1 + exp(-(embedding[1]::DOUBLE))), 6) AS prob_human FROM embeddings""")
def sigmoid_prob(spark, sf_dir):
    p = S.sigmoid(F.col("embedding")[0].cast("double"))
    out = B.table(spark, sf_dir, "embeddings").select("vec_id", p.alias("prob_ai"), (1 - p).alias("prob_human"))
    return out.select("vec_id", *B.r6("prob_ai", "prob_human"))


@B.register("confidence", f"""
WITH {_ERRORS} SELECT row_id, round(confidence, 6) AS confidence, round(greatest(prob_ai, 1 - prob_ai), 6) AS shown FROM errs""")
def confidence(spark, sf_dir):
    out = B.predictions(spark, sf_dir).select(
        "row_id", S.confidence("prob_ai", "prediction").alias("confidence"), S.shown_confidence("prob_ai").alias("shown")
    )
    return out.select("row_id", *B.r6("confidence", "shown"))


@B.register("is_correct", f"WITH {_ERRORS} SELECT row_id, is_correct FROM errs")
def is_correct(spark, sf_dir):
    return B.predictions(spark, sf_dir).select("row_id", S.is_correct("label", "prediction").alias("is_correct"))


@B.register("confusion_matrix", f"""
WITH {B.PREDS}, l AS (SELECT unnest([0, 0, 1, 1]) AS label, unnest([0, 1, 0, 1]) AS prediction)
SELECT l.label::INTEGER AS label, l.prediction::INTEGER AS prediction, count(p.row_id) AS n
FROM l LEFT JOIN preds p ON l.label = p.label AND l.prediction = p.prediction GROUP BY ALL""")
def confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(B.predictions(spark, sf_dir)).drop("share")


@B.register("confusion_normalized", f"""
WITH {B.PREDS}, l AS (SELECT unnest([0, 0, 1, 1]) AS label, unnest([0, 1, 0, 1]) AS prediction),
c AS (SELECT l.label, l.prediction, count(p.row_id) AS n
      FROM l LEFT JOIN preds p ON l.label = p.label AND l.prediction = p.prediction GROUP BY ALL)
SELECT label::INTEGER AS label, prediction::INTEGER AS prediction,
       round(coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY label), 0), 0), 6)::DOUBLE AS share FROM c""")
def confusion_normalized(spark, sf_dir):
    return M.confusion_matrix(B.predictions(spark, sf_dir)).select("label", "prediction", *B.r6("share"))


@B.register("accuracy", f"WITH {B.PREDS} SELECT round(avg((label = prediction)::INT), 6)::DOUBLE AS accuracy FROM preds")
def accuracy(spark, sf_dir):
    return M.accuracy(B.predictions(spark, sf_dir)).select(*B.r6("accuracy"))


@B.register("macro_f1", f"WITH {B.PREDS}, {_MATRIX}, {_MEASURES} SELECT round((f1_human + f1_ai) / 2, 6)::DOUBLE AS macro_f1 FROM r")
def macro_f1(spark, sf_dir):
    return M.macro_f1(B.predictions(spark, sf_dir)).select(*B.r6("macro_f1"))


_PRF = f"""{B.PREDS}, {_MATRIX}, {_MEASURES},
prf AS (SELECT 'human' AS label_name, precision_human AS precision, recall_human AS recall, f1_human AS f1, support_human AS support FROM r
        UNION ALL SELECT 'ai', precision_ai, recall_ai, f1_ai, support_ai FROM r)"""


@B.register("per_class_prf", f"""
WITH {_PRF} SELECT label_name, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall,
       round(f1, 6)::DOUBLE AS f1, support FROM prf""")
def per_class_prf(spark, sf_dir):
    out = M.per_class_prf(B.predictions(spark, sf_dir))
    return out.select("label_name", *B.r6("precision", "recall", "f1"), "support")


@B.register("class_bars", f"""
WITH {_PRF} SELECT label_name, 'precision' AS measure, round(precision, 6)::DOUBLE AS score FROM prf
UNION ALL SELECT label_name, 'recall', round(recall, 6)::DOUBLE FROM prf UNION ALL SELECT label_name, 'f1', round(f1, 6)::DOUBLE FROM prf""")
def class_bars(spark, sf_dir):
    out = M.class_bars(M.per_class_prf(B.predictions(spark, sf_dir)))
    return out.select("label_name", "measure", *B.r6("score"))


@B.register("auc_roc", f"WITH {B.PREDS}, {_HIST}, {_AUC} SELECT round(auc_roc, 6)::DOUBLE AS auc_roc FROM auc")
def auc_roc(spark, sf_dir):
    return M.auc_roc(B.predictions(spark, sf_dir)).select(*B.r6("auc_roc"))


@B.register("auc_roc_embeddings", f"""
WITH preds AS (SELECT (label >= 5)::INTEGER AS label, embedding[1]::DOUBLE AS prob_ai FROM embeddings), {_HIST}, {_AUC}
SELECT round(auc_roc, 6)::DOUBLE AS auc_roc FROM auc""")
def auc_roc_embeddings(spark, sf_dir):
    """Scores outside [0, 1] and all but distinct."""
    scored = B.table(spark, sf_dir, "embeddings").select(
        (F.col("label") >= 5).cast("int").alias("label"), F.col("embedding")[0].cast("double").alias("prob_ai")
    )
    return M.auc_roc(scored).select(*B.r6("auc_roc"))


@B.register("metric_bundle", f"""
WITH {B.PREDS}, {_HIST}, {_AUC}, {_MATRIX}, {_MEASURES}
SELECT round(accuracy, 6) AS accuracy, round((f1_human + f1_ai) / 2, 6)::DOUBLE AS macro_f1, round(auc_roc, 6)::DOUBLE AS auc_roc,
  round(precision_human, 6)::DOUBLE AS precision_human, round(recall_human, 6)::DOUBLE AS recall_human, round(f1_human, 6)::DOUBLE AS f1_human,
  support_human, round(precision_ai, 6)::DOUBLE AS precision_ai, round(recall_ai, 6)::DOUBLE AS recall_ai, round(f1_ai, 6)::DOUBLE AS f1_ai,
  support_ai, tn, fp, fn, tp, 0.5::DOUBLE AS threshold, tn + fp + fn + tp AS n_samples FROM r, auc""")
def metric_bundle(spark, sf_dir):
    out = M.metric_bundle(B.predictions(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) if c in _RATES else F.col(c) for c in out.columns])


@B.register("metric_bundle_by_language", f"""
WITH {B.PREDS},
h AS (SELECT language, prob_ai AS prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM preds GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY language ORDER BY prob) - neg AS below,
             sum(pos) OVER (PARTITION BY language) AS p, sum(neg) OVER (PARTITION BY language) AS n FROM h)
SELECT language, round(sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(max(p)::DOUBLE * max(n), 0), 6)::DOUBLE AS auc_roc,
  round(sum(CASE WHEN prob >= 0.5 THEN pos ELSE neg END)::DOUBLE / sum(pos + neg), 6)::DOUBLE AS accuracy,
  sum(pos + neg)::BIGINT AS n_samples FROM c GROUP BY language""")
def metric_bundle_by_language(spark, sf_dir):
    """All groups at once, from the same histogram."""
    out = M.metric_bundle(B.predictions(spark, sf_dir), by=["language"])
    return out.select("language", *B.r6("auc_roc", "accuracy"), "n_samples")


@B.register("metrics_to_long", f"""
WITH {B.PREDS}, {_HIST}, {_AUC}, {_MATRIX}, {_MEASURES}, w AS (SELECT *, (f1_human + f1_ai) / 2 AS macro_f1 FROM r, auc),
long AS (SELECT unnest(['Accuracy', 'Macro F1', 'AUC-ROC', 'Precision (human)', 'Recall (human)', 'F1 (human)',
                        'Precision (ai)', 'Recall (ai)', 'F1 (ai)']) AS metric,
  unnest([accuracy, macro_f1, auc_roc, precision_human, recall_human, f1_human, precision_ai, recall_ai, f1_ai]) AS value FROM w)
SELECT metric, round(value, 6)::DOUBLE AS value, coalesce(printf('%.4f', value), 'TBD') AS shown FROM long""")
def metrics_to_long(spark, sf_dir):
    out = M.metrics_to_long(M.metric_bundle(B.predictions(spark, sf_dir)))
    return out.select("metric", *B.r6("value"), "shown")


@B.register("roc_curve", f"""
WITH {B.PREDS}, {_HIST},
c AS (SELECT prob, sum(pos) OVER (ORDER BY prob DESC) AS tp, sum(neg) OVER (ORDER BY prob DESC) AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM h)
SELECT prob::DOUBLE AS threshold, round(fp::DOUBLE / n, 6)::DOUBLE AS fpr, round(tp::DOUBLE / p, 6)::DOUBLE AS tpr FROM c
UNION ALL SELECT 2.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""")
def roc_curve(spark, sf_dir):
    """The origin's infinite threshold is shown as 2."""
    out = M.roc_curve(B.predictions(spark, sf_dir))
    shown = F.when(F.col("threshold") == float("inf"), 2.0).otherwise(F.col("threshold"))
    return out.select(shown.alias("threshold"), *B.r6("fpr", "tpr"))


@B.register("roc_curve_corners", f"""
WITH {B.PREDS}, {_HIST},
c AS (SELECT prob, sum(pos) OVER (ORDER BY prob DESC) AS tp, sum(neg) OVER (ORDER BY prob DESC) AS fp,
             sum(pos) OVER () AS p, sum(neg) OVER () AS n, pos, neg,
             lead(pos) OVER (ORDER BY prob DESC) AS next_pos, lead(neg) OVER (ORDER BY prob DESC) AS next_neg,
             row_number() OVER (ORDER BY prob DESC) AS i FROM h)
SELECT prob::DOUBLE AS threshold, round(fp::DOUBLE / n, 6)::DOUBLE AS fpr, round(tp::DOUBLE / p, 6)::DOUBLE AS tpr FROM c
WHERE i = 1 OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
UNION ALL SELECT 2.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""")
def roc_curve_corners(spark, sf_dir):
    out = M.roc_curve(B.predictions(spark, sf_dir), drop_collinear=True)
    shown = F.when(F.col("threshold") == float("inf"), 2.0).otherwise(F.col("threshold"))
    return out.select(shown.alias("threshold"), *B.r6("fpr", "tpr"))


@B.register("mean_bce_loss", f"""
WITH {B.PREDS}, c AS (SELECT language, label, least(greatest(prob_ai, 1e-15), 1 - 1e-15) AS p FROM preds)
SELECT language, round(avg(-CASE label WHEN 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS loss, count(*) AS n FROM c GROUP BY language""")
def mean_bce_loss(spark, sf_dir):
    out = M.mean_bce_loss(B.predictions(spark, sf_dir), by=["language"])
    return out.select("language", *B.r6("loss"), "n")


@B.register("mean_bce_loss_logits", """
WITH c AS (SELECT embedding[1]::DOUBLE AS x, (label >= 5)::INTEGER AS y FROM embeddings)
SELECT round(avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))), 6) AS loss, count(*) AS n FROM c""")
def mean_bce_loss_logits(spark, sf_dir):
    rows = B.table(spark, sf_dir, "embeddings").select(
        (F.col("label") >= 5).cast("int").alias("label"), F.col("embedding")[0].cast("double").alias("logit")
    )
    return M.mean_bce_loss(rows, logit="logit").select(*B.r6("loss"), "n")


@B.register("align_predictions", f"""
WITH {B.PREDS} SELECT row_id, label, prediction, round(prob_ai, 6) AS prob_ai, md5(code) AS code_md5 FROM preds""")
def align_predictions(spark, sf_dir):
    both = B.predictions(spark, sf_dir)
    scored, texts = both.select("row_id", "label", "prob_ai", "prediction"), both.select("row_id", "code")
    out = E.align_predictions(scored, texts)
    return out.select("row_id", "label", "prediction", *B.r6("prob_ai"), F.md5("code").alias("code_md5"))


@B.register("errors_only", f"WITH {_ERRORS} SELECT row_id, label_name, prediction_name FROM errs WHERE NOT is_correct")
def errors_only(spark, sf_dir):
    return E.errors_only(_errors(spark, sf_dir)).select("row_id", "label_name", "prediction_name")


@B.register("correct_only", f"WITH {_ERRORS} SELECT row_id, label_name, prediction_name FROM errs WHERE is_correct")
def correct_only(spark, sf_dir):
    return E.correct_only(_errors(spark, sf_dir)).select("row_id", "label_name", "prediction_name")


_ERROR_COLUMNS = "row_id, label, label_name, prediction, prediction_name, round(prob_ai, 6) AS prob_ai, n_chars, n_lines, round(confidence, 6) AS confidence"


def _shown(df):
    return df.select(
        "row_id", "label", "label_name", "prediction", "prediction_name", *B.r6("prob_ai"), "n_chars", "n_lines", *B.r6("confidence")
    )


@B.register("rank_errors", f"WITH {_ERRORS} SELECT {_ERROR_COLUMNS} FROM errs WHERE NOT is_correct ORDER BY confidence DESC, row_id")
def rank_errors(spark, sf_dir):
    return _shown(E.rank_errors(_errors(spark, sf_dir)))


@B.register("top_errors", f"""
WITH {_ERRORS}, best AS (SELECT * FROM errs WHERE NOT is_correct ORDER BY confidence DESC, row_id LIMIT 20) SELECT {_ERROR_COLUMNS} FROM best""")
def top_errors(spark, sf_dir):
    return _shown(E.top_errors(_errors(spark, sf_dir), 20))


@B.register("error_summary", f"""
WITH {_ERRORS} SELECT count(*) AS n_test, count(*) FILTER (NOT is_correct) AS n_errors,
  round(count(*) FILTER (NOT is_correct)::DOUBLE / greatest(count(*), 1), 6) AS error_rate,
  count(*) FILTER (NOT is_correct AND label = 0) AS errors_true_human, count(*) FILTER (NOT is_correct AND label = 1) AS errors_true_ai,
  count(*) FILTER (NOT is_correct AND prediction = 0) AS errors_predicted_human,
  count(*) FILTER (NOT is_correct AND prediction = 1) AS errors_predicted_ai,
  round(avg(confidence) FILTER (NOT is_correct), 6) AS mean_confidence_on_errors,
  round(quantile_cont(confidence, 0.5) FILTER (NOT is_correct), 6) AS median_confidence_on_errors,
  round(avg(n_chars) FILTER (NOT is_correct), 6) AS errors_n_chars_mean, round(avg(n_chars) FILTER (is_correct), 6) AS correct_n_chars_mean,
  round(avg(n_lines) FILTER (NOT is_correct), 6) AS errors_n_lines_mean, round(avg(n_lines) FILTER (is_correct), 6) AS correct_n_lines_mean
FROM errs""")
def error_summary(spark, sf_dir):
    out = E.error_summary(_errors(spark, sf_dir))
    floats = [f for f, t in out.dtypes if t == "double"]
    return out.select(*[F.round(c, 6).alias(c) if c in floats else F.col(c) for c in out.columns])
