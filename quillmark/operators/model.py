"""Fit, select, score: a linear classifier over hashed tokens, by MLlib."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.base import Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.functions import text as X
from quillmark.operators import metrics as M
from quillmark.session import stored
from quillmark.sources import artifacts as A


@dataclass(frozen=True)
class RunConfig:
    num_features: int = 1 << 18
    max_tokens: int = C.MAX_TOKENS
    decision_threshold: float = C.THRESHOLD
    early_stop_patience: int = C.PATIENCE
    random_seed: int = C.SEED
    extra: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Candidate:
    """One training step's settings; steps are tried in order."""

    reg_param: float = 1e-3
    max_iter: int = 50
    tolerance: float = 1e-6


DEFAULT_CANDIDATES = (Candidate(1e-1), Candidate(1e-2), Candidate(1e-3))

Predictor = Transformer | Callable[[pd.Series], pd.Series]


#: What a model reads: texts, or the ids that the tokenizer has stored for them; and the model's own name for it.
SOURCES = {"code": "__code", "input_ids": "__ids"}


def _hashing(config: RunConfig, source: str = "code") -> list[Transformer]:
    """All tokens of ``__code`` as hashed counts, uncut: a bag of words has no length limit. Nothing to fit.

    Of stored ids, all but marks and padding: those of a text's first tokens, as many as were encoded.
    Columns of the model have names of their own, so that none of the scored table's is in the way.
    """
    tokens = {
        "code": f"regexp_extract_all(__code, r'{X.TOKEN_PATTERN}', 0) AS __tokens",
        "input_ids": f"transform(filter(__ids, i -> i >= {C.UNKNOWN_ID}), i -> cast(i AS string)) AS __tokens",
    }[source]
    return [
        SQLTransformer(statement=f"SELECT *, {tokens} FROM __THIS__"),
        HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=config.num_features),
    ]


def _counts(df: DataFrame, config: RunConfig, name: str, label: str = "label", source: str = "code") -> DataFrame:
    """(label, __tf) stored in the shared folder: fitting passes many times over these, once over texts."""
    rows = df.select(F.col(label).cast("double").alias("label"), F.col(source).alias(SOURCES[source]))
    return stored(PipelineModel(_hashing(config, source)).transform(rows).select("label", "__tf"), name)


def hashed_token_total(df: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """One row: texts, and tokens that reach a model fitted on them."""
    rows = df.select(F.col("code").alias("__code"))
    hashed = PipelineModel(_hashing(config)).transform(rows)
    return hashed.agg(
        F.count("*").alias("n_rows"), F.aggregate(vector_to_array(Summarizer.sum(F.col("__tf"))), F.lit(0.0), lambda a, b: a + b).cast("bigint").alias("n_tokens")
    )


def _fit_idf(train_counts: DataFrame) -> Transformer:
    return IDF(inputCol="__tf", outputCol="__features").fit(train_counts)


def _regression(candidate: Candidate) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="__features", labelCol="label", regParam=candidate.reg_param, maxIter=candidate.max_iter,
        tol=candidate.tolerance,
        rawPredictionCol="__raw", probabilityCol="__probability", predictionCol="__class",
    )


def fit_classifier(
    train: DataFrame, config: RunConfig = RunConfig(), candidate: Candidate = Candidate(), label: str = "label",
    source: str = "code",
) -> PipelineModel:
    """Hashed tokens weighted by IDF, then a regression; all fitted on the given rows only (the train split).

    ``source="input_ids"`` fits on a stored encoded table, whose texts aren't needed any more.
    """
    counts = _counts(train, config, "train-counts", label, source)
    idf = _fit_idf(counts)
    return PipelineModel([*_hashing(config, source), idf, _regression(candidate).fit(idf.transform(counts))])


def score(
    df: DataFrame, predictor: Predictor, threshold: float = C.THRESHOLD, code: str = "code", ids: str = "input_ids"
) -> DataFrame:
    """Add ``prob_ai`` and ``prediction``, in place of earlier ones; the rows keep all other columns as they are.

    ``predictor`` is a fitted MLlib model, or a pandas UDF body from texts to probabilities (typed as an
    iterator of batches it can load its model once per worker). Either way no row moves. A model fitted on encoded tables reads
    ``ids`` instead of texts.
    """
    if isinstance(predictor, Transformer):
        given = {SOURCES[s]: F.col(c) for s, c in (("code", code), ("input_ids", ids)) if c in df.columns}
        scored = predictor.transform(df.withColumns(given))
        scored = scored.withColumn("prob_ai", vector_to_array("__probability")[1])
    else:
        scored = df.withColumn("prob_ai", F.pandas_udf(predictor, "double")(F.col(code)))
    with_class = M.with_prediction(scored, threshold)
    return with_class.select(*[c for c in df.columns if c not in ("prob_ai", "prediction")], "prob_ai", "prediction")


@dataclass
class Selection:
    """Outcome of `select_best_model`: the best step's model, and what every step measured."""

    model: PipelineModel
    history: DataFrame
    best_epoch: int
    best_val_loss: float


def _selection_key(
    train: DataFrame, validation: DataFrame, config: RunConfig, candidates: Sequence[Candidate], run_id: str, source: str
) -> str:
    """What a selection depends on: settings, and a checksum of the rows."""

    def checksum(rows: DataFrame) -> str:
        row = rows.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("label", source)).alias("x"), F.sum(F.xxhash64(source) % 1_000_003).alias("s"))
        return str(tuple(row.first()))

    return repr((run_id, source, asdict(config), [asdict(c) for c in candidates], checksum(train), checksum(validation)))


def select_best_model(
    train: DataFrame, validation: DataFrame, config: RunConfig = RunConfig(),
    candidates: Sequence[Candidate] = DEFAULT_CANDIDATES, run_dir: str | None = None, run_id: str = "run",
    source: str = "code",
) -> Selection:
    """Try the candidates in order, keep the one with the lowest validation loss, stop when patience ends.

    A step improves only if it lowers the best loss by more than the tolerance. Hashed counts are written
    once, so each step reads vectors instead of texts. With a ``run_dir`` every improvement is saved, then the history up to the step;
    a run that was cut off goes on after its last finished step, if settings and rows are the same.
    """
    if not candidates:
        raise ValueError("no candidates to choose from")
    spark = train.sparkSession
    history: list[tuple] = []
    if run_dir:
        key = _selection_key(train, validation, config, candidates, run_id, source)
        if A.scan_selection(spark, run_dir) == key:
            # As many rows as candidates were tried.
            history = [tuple(r) for r in A.scan_history(spark, run_dir).orderBy("epoch").collect()]
        else:
            A.write_history(spark.createDataFrame([], A.HISTORY_SCHEMA), run_dir)
            A.write_selection(spark, key, run_dir)
    best, best_epoch, best_loss, bad = None, 0, float("inf"), 0
    for row in history:
        epoch, val_loss = row[1], row[3]
        if val_loss < best_loss - C.MIN_IMPROVEMENT:
            best_epoch, best_loss, bad = epoch, val_loss, 0
        else:
            bad += 1
    if history:
        best = A.load_model(spark, run_dir)[0]
    left = [] if bad >= config.early_stop_patience else list(enumerate(candidates, start=1))[len(history):]
    if left:
        train_counts = _counts(train, config, "train-counts", source=source)
        val_counts = _counts(validation, config, "validation-counts", source=source)
        idf = _fit_idf(train_counts)
    for epoch, candidate in left:
        started = time.time()
        fitted = _regression(candidate).fit(idf.transform(train_counts))

        def scored(counts: DataFrame) -> DataFrame:
            out = fitted.transform(idf.transform(counts))
            return out.select(F.col("label").cast("int"), vector_to_array("__probability")[1].alias("prob_ai"))

        train_loss = M.mean_bce_loss(scored(train_counts)).first()["loss"]
        val_scored = stored(scored(val_counts), "validation-scores")
        val_loss = M.mean_bce_loss(val_scored).first()["loss"]
        scores = M.score_table(val_scored)
        M.validate_predictions(scores)
        bundle = M.nested_bundle(M.metric_bundle(scores, config.decision_threshold)).first()
        seconds = time.time() - started
        history.append((run_id, epoch, train_loss, val_loss, bundle, None, candidate.reg_param, seconds))
        improved = val_loss < best_loss - C.MIN_IMPROVEMENT
        if improved:
            best = PipelineModel([*_hashing(config, source), idf, fitted])
            best_epoch, best_loss, bad = epoch, val_loss, 0
        else:
            bad += 1
        if run_dir:
            if improved:  # before the history, so that a step which is in the history has its model
                A.save_model(best, run_dir)
                A.write_config(spark, asdict(config), run_dir)
            A.write_history(spark.createDataFrame(history, A.HISTORY_SCHEMA), run_dir)
        if bad >= config.early_stop_patience:
            break
    return Selection(best, spark.createDataFrame(history, A.HISTORY_SCHEMA), best_epoch, best_loss)


def verdicts(df: DataFrame, predictor: Predictor, threshold: float, max_tokens: int, code: str = "code") -> DataFrame:
    """Verdict columns for every text: class, probabilities, threshold, characters, tokens."""
    scored = score(df, predictor, threshold, code)
    kept = F.least(F.size(X.tokens(code)), F.lit(max_tokens - 2)) + 2
    return scored.select(
        *[c for c in df.columns if c != code],
        X.label_name("prediction").alias("label_name"),
        "prediction",
        "prob_ai",
        (1.0 - F.col("prob_ai")).alias("prob_human"),
        F.lit(float(threshold)).alias("threshold"),
        X.n_chars(code).alias("n_chars"),
        kept.alias("n_tokens"),
    )


def effective_threshold(given: float | None, config: dict) -> float:
    """The given threshold, else the one stored with the run."""
    return config["decision_threshold"] if given is None else given
