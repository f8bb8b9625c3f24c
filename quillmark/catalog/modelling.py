"""Registered queries: fitting, scoring, selection, streaming.

Scores fitted on whole texts cannot be repeated in SQL; there it checks a property of all rows. Where scores themselves are compared,
each text is one of two words: the best fit without penalty then gives each word's share of the class, and with an endless one the
overall share, both of which SQL knows.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.catalog import base as B
from quillmark.catalog import measuring as ME
from quillmark.operators import metrics as M
from quillmark.operators import model as MO
from quillmark.operators import split as SP
from quillmark.plans import phases as PH
from quillmark.session import scratch_path, stored
from quillmark.sources import artifacts as A
from quillmark.streaming import classify as ST

CONFIG = MO.RunConfig(num_features=1 << 14)
CANDIDATE = MO.Candidate(reg_param=0.01, max_iter=20)


#: Fits with a known result: each word's share, and the overall share.
EXACT = MO.Candidate(reg_param=0.0, max_iter=500, tolerance=1e-13)
FLAT = MO.Candidate(reg_param=1e8, max_iter=100, tolerance=1e-13)

_WORD = "CASE WHEN language = 'en' THEN 'english' ELSE 'other' END"
_SHARES = f"""{B.SNIPS}, {B.sql_split('snips', 'label')},
words AS (SELECT *, {_WORD} AS word FROM parted),
shares AS (SELECT word, avg(label)::DOUBLE AS p FROM words WHERE split = 'train' GROUP BY word),
flat AS (SELECT avg(label)::DOUBLE AS p0 FROM words WHERE split = 'train'),
known AS (SELECT row_id, code, label, split, p, p0 FROM words JOIN shares USING (word), flat)"""


def _near(column: str) -> Column:
    """To four decimals, rounded where shares of few rows don't lie on the border."""
    return F.round(F.col(column) + 0.00003, 4)


def _two_words(spark, sf_dir):
    word = F.when(F.col("language") == "en", "english").otherwise("other")
    return B.snippets(spark, sf_dir).withColumn("code", word)


def _splits(spark, sf_dir, rows=None) -> str:
    path = scratch_path(spark, "splits")
    A.write_splits(SP.stratified_split(B.snippets(spark, sf_dir) if rows is None else rows), path)
    return path


def _exact_run(spark, sf_dir) -> tuple[str, str]:
    """(run folder, split folder) of a saved model whose probabilities are the words' shares."""
    splits, run = _splits(spark, sf_dir, _two_words(spark, sf_dir)), scratch_path(spark, "run")
    A.save_model(MO.fit_classifier(A.scan_split(spark, splits, "train"), CONFIG, EXACT), run)
    A.write_config(spark, asdict(CONFIG), run)
    return run, splits


def _run(spark, sf_dir) -> tuple[str, str]:
    """(run folder, split folder) of a model fitted on the train split and saved."""
    splits, run = _splits(spark, sf_dir), scratch_path(spark, "run")
    model = MO.fit_classifier(A.scan_split(spark, splits, "train"), CONFIG, CANDIDATE)
    A.save_model(model, run)
    A.write_config(spark, asdict(CONFIG), run)
    return run, splits


@B.register("fit_classifier", f"""
WITH {B.SNIPS} SELECT count(*) FILTER (label = 0) AS support_human, count(*) FILTER (label = 1) AS support_ai,
       count(*) AS n_samples, true AS beats_prior FROM snips""")
def fit_classifier(spark, sf_dir):
    """Measures on the rows it was fitted on; its loss must be below that of always giving the class shares."""
    rows = B.snippets(spark, sf_dir, heavy=True)
    model = MO.fit_classifier(rows, CONFIG, CANDIDATE)
    scored = stored(MO.score(rows, model).select("label", "prob_ai"), "scores")
    share = F.avg("label")
    prior = scored.agg((-share * F.ln(share) - (1 - share) * F.ln(1 - share)).alias("prior"))
    loss = M.mean_bce_loss(scored).select("loss")
    bundle = M.metric_bundle(scored).select("support_human", "support_ai", "n_samples")
    return bundle.withColumn("beats_prior", loss.scalar() < prior.scalar())


@B.register("score", f"WITH {B.SNIPS} SELECT row_id, label, true AS in_range, true AS at_threshold FROM snips")
def score(spark, sf_dir):
    """Every row keeps its key and label, gets a probability, and a class by the inclusive threshold."""
    run, splits = _run(spark, sf_dir)
    model, config = A.load_model(spark, run)
    scored = MO.score(A.scan_splits(spark, splits), model, config["decision_threshold"])
    return scored.select(
        "row_id",
        "label",
        F.col("prob_ai").between(0, 1).alias("in_range"),
        (F.col("prediction") == (F.col("prob_ai") >= 0.5).cast("int")).alias("at_threshold"),
    )


@B.register("score_probabilities", f"""
WITH {_SHARES} SELECT row_id, label, round(p + 0.00003, 4)::DOUBLE AS prob_ai, (p >= 0.5)::INTEGER AS prediction FROM known""")
def score_probabilities(spark, sf_dir):
    """Probabilities of a fitted, saved and loaded model, on texts of two words."""
    run, splits = _exact_run(spark, sf_dir)
    model, config = A.load_model(spark, run)
    scored = MO.score(A.scan_splits(spark, splits), model, config["decision_threshold"])
    return scored.select("row_id", "label", _near("prob_ai").alias("prob_ai"), "prediction")


@B.register("train_encoded", f"""
WITH {_SHARES} SELECT row_id, label, split, round(p + 0.00003, 4)::DOUBLE AS prob_ai FROM known""")
def train_encoded(spark, sf_dir):
    """Chosen, saved, loaded and scored on the stored encoded table alone; texts of two words."""
    splits = _splits(spark, sf_dir, _two_words(spark, sf_dir))
    encoded, run, predictions = (scratch_path(spark, n) for n in ("encoded", "run", "predictions"))
    PH.tokenize(spark, splits, encoded, scratch_path(spark, "vocab"), 16, 100)
    PH.train(spark, encoded, run, CONFIG, [EXACT], encoded=True)
    PH.evaluate_splits(spark, encoded, run, predictions, encoded=True)
    scored = spark.read.parquet(predictions)
    return scored.select("row_id", "label", F.col("split").cast("string").alias("split"), _near("prob_ai").alias("prob_ai"))


@B.register("hashed_token_total", f"""
WITH {B.SNIPS} SELECT count(*) AS n_rows, sum(len({B.SQL_TOKENS}))::BIGINT AS n_tokens FROM snips""")
def hashed_token_total(spark, sf_dir):
    """Every token of every labelled text reaches the model."""
    return MO.hashed_token_total(B.snippets(spark, sf_dir, heavy=True), CONFIG)


@B.register("score_keeps_columns", f"""
WITH {B.SNIPS} SELECT row_id, label, 'x' || code AS code, language AS tokens, 7 AS probability, true AS same FROM snips""")
def score_keeps_columns(spark, sf_dir):
    """Scored twice, with columns that a model might use itself: all come back as they were."""
    run, splits = _run(spark, sf_dir)
    model, _ = A.load_model(spark, run)
    rows = A.scan_splits(spark, splits).select(
        "row_id", "label", F.concat(F.lit("x"), "code").alias("code"), F.col("language").alias("tokens"), F.lit(7).alias("probability"),
        F.col("code").alias("text"),
    )
    once = MO.score(rows, model, code="text")
    again = MO.score(once.withColumn("first", F.col("prob_ai")), model, code="text")
    return again.select("row_id", "label", "code", "tokens", "probability", (F.abs(F.col("first") - F.col("prob_ai")) < 1e-12).alias("same"))


@B.register("score_function", f"""
WITH {B.SNIPS} SELECT row_id, label, round(1 / (1 + exp(-(length(code) % 7 - 3)::DOUBLE)), 6) AS prob_ai,
  (length(code) % 7 >= 3)::INTEGER AS prediction FROM snips""")
def score_function(spark, sf_dir):
    """A scorer given as a function on Arrow batches."""

    def by_length(code):
        import numpy as np

        return 1 / (1 + np.exp(-(code.str.len() % 7 - 3.0)))

    out = MO.score(B.snippets(spark, sf_dir, heavy=True), by_length)
    return out.select("row_id", "label", *B.r6("prob_ai"), "prediction")


@B.register("load_model", f"WITH {B.SNIPS} SELECT count(*) AS n_rows, 0::BIGINT AS n_different FROM snips")
def load_model(spark, sf_dir):
    """A saved and loaded model scores every row as the fitted one does."""
    rows, run = B.snippets(spark, sf_dir, heavy=True), scratch_path(spark, "run")
    fitted = MO.fit_classifier(rows, CONFIG, CANDIDATE)
    A.save_model(fitted, run)
    A.write_config(spark, asdict(CONFIG), run)
    loaded, _ = A.load_model(spark, run)
    again = MO.score(rows, loaded).select("row_id", F.col("prob_ai").alias("again"))
    both = MO.score(rows, fitted).join(again, "row_id")
    different = F.abs(F.col("prob_ai") - F.col("again")) > 1e-12
    return both.agg(F.count("*").alias("n_rows"), F.count_if(different).alias("n_different"))


@B.register("save_model", f"""
WITH {B.SNIPS}, {B.sql_split('snips', 'label')}
SELECT row_id, 0.25::DOUBLE AS threshold, (least(len({B.SQL_TOKENS}), 62) + 2)::INTEGER AS n_tokens FROM parted WHERE split = 'test'""")
def save_model(spark, sf_dir):
    """Stored settings rule what the loaded model does: threshold and token limit."""
    splits, run = _splits(spark, sf_dir), scratch_path(spark, "run")
    config = MO.RunConfig(num_features=1 << 12, max_tokens=64, decision_threshold=0.25)
    A.save_model(MO.fit_classifier(A.scan_split(spark, splits, "train"), config, CANDIDATE), run)
    A.write_config(spark, asdict(config), run)
    model, stored_config = A.load_model(spark, run)
    limit = MO.effective_threshold(None, stored_config)
    rows = A.scan_split(spark, splits, "test").select("row_id", "code")
    return MO.verdicts(rows, model, limit, stored_config["max_tokens"]).select("row_id", "threshold", "n_tokens")


_LOSS = "avg(-CASE label WHEN 1 THEN ln(greatest({p}, 1e-15)) ELSE ln(greatest(1 - {p}, 1e-15)) END)"


@B.register("select_best_model", f"""
WITH {_SHARES},
losses AS (SELECT {_LOSS.format(p='p0')} AS flat, {_LOSS.format(p='p')} AS exact, count(*) AS n FROM known WHERE split = 'validation'),
steps AS (SELECT unnest([1, 2, 3])::INTEGER AS epoch, unnest([flat, exact, flat]) AS loss, n, (CASE WHEN exact < flat - 1e-6 THEN 2 ELSE 1 END)::INTEGER AS best FROM losses)
SELECT epoch, n AS n_validation, round(loss + 0.00003, 4)::DOUBLE AS val_loss, best AS best_epoch FROM steps""")
def select_best_model(spark, sf_dir):
    """Losses of all candidates on the validation rows, and the choice; on texts of two words."""
    splits = _splits(spark, sf_dir, _two_words(spark, sf_dir))
    chosen = PH.train(spark, splits, scratch_path(spark, "run"), CONFIG, [FLAT, EXACT, FLAT])
    return chosen.history.select(
        "epoch", F.col("val_metrics.n_samples").alias("n_validation"), _near("val_loss").alias("val_loss"),
        F.lit(chosen.best_epoch).cast("int").alias("best_epoch"),
    )


@B.register("evaluate_split", f"""
WITH {_SHARES}, preds AS (SELECT label, p AS prob_ai, (p >= 0.8613)::INTEGER AS prediction FROM known WHERE split = 'test'),
{ME._HIST}, {ME._AUC}, {ME._MATRIX}, {ME._MEASURES}
SELECT round(auc_roc, 6)::DOUBLE AS auc_roc, round(accuracy, 6)::DOUBLE AS accuracy, tn, fp, fn, tp, 0.8613::DOUBLE AS threshold FROM r, auc""")
def evaluate_split(spark, sf_dir):
    """The test split scored and measured."""
    run, splits = _exact_run(spark, sf_dir)
    result = PH.evaluate(spark, splits, run, scratch_path(spark, "predictions"), scratch_path(spark, "metrics"), threshold=0.8613)
    return result.bundle.select(*B.r6("auc_roc", "accuracy"), "tn", "fp", "fn", "tp", "threshold")


@B.register("evaluate_splits", f"""
WITH {_SHARES}, preds AS (SELECT split, label, p AS prob_ai FROM known UNION ALL SELECT 'all', label, p FROM known),
h AS (SELECT split, prob_ai AS prob, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM preds GROUP BY ALL),
c AS (SELECT *, sum(neg) OVER (PARTITION BY split ORDER BY prob) - neg AS below,
             sum(pos) OVER (PARTITION BY split) AS p, sum(neg) OVER (PARTITION BY split) AS n FROM h)
SELECT split, round(sum(pos * (below + neg / 2.0::DOUBLE)) / (max(p)::DOUBLE * max(n)), 6)::DOUBLE AS auc_roc,
       round(sum(CASE WHEN prob >= 0.8613 THEN pos ELSE neg END)::DOUBLE / sum(pos + neg), 6)::DOUBLE AS accuracy,
       sum(CASE WHEN prob >= 0.8613 THEN pos ELSE 0 END)::BIGINT AS tp, sum(CASE WHEN prob >= 0.8613 THEN neg ELSE 0 END)::BIGINT AS fp,
       sum(pos + neg)::BIGINT AS n_samples FROM c GROUP BY split""")
def evaluate_splits(spark, sf_dir):
    """All splits, and all together, from one pass; read back from the stored reports."""
    run, splits = _exact_run(spark, sf_dir)
    reports = scratch_path(spark, "metrics")
    result = PH.evaluate_splits(spark, splits, run, scratch_path(spark, "predictions"), reports, threshold=0.8613)
    counts = result.bundle.select("split", "tp", "fp")
    saved = A.parse_metrics(A.scan_metric_files(spark, reports)).withColumnRenamed("name", "split").join(counts, "split")
    return saved.select("split", *B.r6("auc_roc", "accuracy"), "tp", "fp", "n_samples")


def _scored_split(spark, sf_dir) -> tuple[str, str]:
    """(predictions, splits): the test split with scores that SQL knows."""
    splits, predictions = _splits(spark, sf_dir), scratch_path(spark, "predictions")
    test = A.scan_split(spark, splits, "test").select("row_id")
    scored = B.predictions(spark, sf_dir).join(test, "row_id")
    scored.select("row_id", "label", "prob_ai", "prediction").write.parquet(predictions)
    return predictions, splits


_TEST_ERRORS = f"""{ME._ERRORS}, {B.sql_split('snips', 'label')},
tested AS (SELECT errs.* FROM errs JOIN parted USING (row_id) WHERE split = 'test')"""


@B.register("analyze_errors", f"""
WITH {_TEST_ERRORS}, best AS (SELECT * FROM tested WHERE NOT is_correct ORDER BY confidence DESC, row_id LIMIT 25)
SELECT row_id, label, prediction_name, n_chars, n_lines, round(confidence, 6) AS confidence, md5(code) AS code_md5 FROM best""")
def analyze_errors(spark, sf_dir):
    """The list of the most confident errors, with their texts."""
    top, _ = PH.analyze_errors(spark, *_scored_split(spark, sf_dir), n=25)
    return top.select("row_id", "label", "prediction_name", "n_chars", "n_lines", *B.r6("confidence"), F.md5("code").alias("code_md5"))


@B.register("analyze_errors_summary", f"""
WITH {_TEST_ERRORS} SELECT count(*) AS n_test, count(*) FILTER (NOT is_correct) AS n_errors,
  count(*) FILTER (NOT is_correct AND label = 0) AS errors_true_human, count(*) FILTER (NOT is_correct AND prediction = 1) AS errors_predicted_ai,
  round(quantile_cont(confidence, 0.5) FILTER (NOT is_correct), 6) AS median_confidence,
  round(avg(n_chars) FILTER (NOT is_correct), 6) AS errors_n_chars_mean, round(avg(n_lines) FILTER (is_correct), 6) AS correct_n_lines_mean FROM tested""")
def analyze_errors_summary(spark, sf_dir):
    _, summary = PH.analyze_errors(spark, *_scored_split(spark, sf_dir), n=None)
    return summary.select(
        "n_test", "n_errors", "errors_true_human", "errors_predicted_ai",
        F.round("median_confidence_on_errors", 6).alias("median_confidence"), *B.r6("errors_n_chars_mean", "correct_n_lines_mean"),
    )


@B.register("classify_files", f"""
SELECT item_id, (length(text) + 1)::BIGINT AS n_chars, (least(len({B.SQL_TOKENS.replace('code', 'text')}), 510) + 2)::INTEGER AS n_tokens,
       true AS adds_up FROM benchmark""")
def classify_files(spark, sf_dir):
    """A file per benchmark item; the fitted probabilities are checked to add up."""
    run, _ = _run(spark, sf_dir)
    path = scratch_path(spark, "text")
    B.table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    verdicts, _ = PH.classify_files(spark, path, run)
    item = F.regexp_extract("file", r"item_id=(\d+)", 1).cast("bigint")
    sound = (F.abs(F.col("prob_ai") + F.col("prob_human") - 1) < 1e-12) & (
        (F.col("label_name") == "ai") == (F.col("prob_ai") >= F.col("threshold"))
    )
    return verdicts.select(item.alias("item_id"), "n_chars", "n_tokens", sound.alias("adds_up"))


@B.register("classify_stream", f"""
WITH {_SHARES}, judged AS (SELECT row_id, language, p FROM words JOIN shares USING (word) WHERE language <> 'de')
SELECT row_id, 'verdict' AS outcome, CASE WHEN p >= 0.5 THEN 'ai' ELSE 'human' END AS label_name, round(p + 0.00003, 4)::DOUBLE AS prob_ai FROM judged
UNION ALL SELECT row_id, 'empty or whitespace only', NULL, NULL FROM snips WHERE language = 'de'""")
def classify_stream(spark, sf_dir):
    """All rows as a stream of files: verdicts, and rejects for the blank texts that stand in for one language."""
    run, _ = _exact_run(spark, sf_dir)
    model, config = A.load_model(spark, run)
    text = F.when(F.col("language") != "de", F.col("code")).otherwise(F.lit(" \n\t"))
    source, sink, rejects = (scratch_path(spark, n) for n in ("in", "out", "rejects"))
    _two_words(spark, sf_dir).select("row_id", "label", text.alias("code")).write.parquet(source)
    query = ST.classify_stream(
        spark, source, model, sink, scratch_path(spark, "checkpoint"), config["decision_threshold"], rejects_dir=rejects
    )
    query.awaitTermination()
    verdicts = spark.read.parquet(sink).select("row_id", F.lit("verdict").alias("outcome"), "label_name", _near("prob_ai").alias("prob_ai"))
    return verdicts.unionByName(
        spark.read.parquet(rejects).select("row_id", F.col("reason").alias("outcome")), allowMissingColumns=True
    )
