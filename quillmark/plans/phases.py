"""The batch flow, phase by phase. Each phase reads what the one before wrote."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.operators import clean as CL
from quillmark.operators import errors as E
from quillmark.operators import metrics as M
from quillmark.operators import model as MO
from quillmark.operators import normalize as N
from quillmark.operators import profile as P
from quillmark.operators import split as SP
from quillmark.operators import tokens as K
from quillmark.session import scratch_path, stored
from quillmark.sources import artifacts as A


@dataclass(frozen=True)
class Prepared:
    """Reports of `prepare`; tables are at the given paths."""

    raw_balance: DataFrame
    languages: DataFrame
    retention: DataFrame
    clean_balance: DataFrame
    split_balance: DataFrame


def prepare(
    spark: SparkSession, raw_dir: str, interim_path: str, split_path: str,
    languages: Sequence[str] = C.PYTHON_ALIASES, min_length: int = C.MIN_CODE_LENGTH,
    ratios: Sequence[float] = (C.TRAIN_RATIO, C.VALIDATION_RATIO, C.TEST_RATIO), seed: int = C.SEED,
    resolve: str = "file",
) -> Prepared:
    """Raw files -> canonical table -> one language, cleaned -> stratified splits."""
    # Written once: text formats are parsed a single time, and positions become stable. Two folders, so
    # that the language filter skips the files of all other languages.
    bronze_path = scratch_path(spark, "bronze")
    wanted = F.col("language").isin(*languages)
    canonical = N.load_canonical(spark, raw_dir, resolve).withColumn("in_language", wanted)
    canonical.write.partitionBy("in_language").parquet(bronze_path)
    bronze = spark.read.parquet(bronze_path)
    target = bronze.where(F.col("in_language").cast("boolean")).drop("in_language")
    kept = CL.filter_language(N.mint_row_ids(target), languages)
    A.write_interim(CL.clean(kept, min_length), interim_path)
    cleaned = A.scan_interim(spark, interim_path)
    A.write_splits(SP.stratified_split(cleaned, ratios=ratios, seed=seed), split_path)
    splits = A.scan_splits(spark, split_path)
    return Prepared(
        raw_balance=P.class_balance(bronze),
        languages=P.distinct_languages(bronze),
        retention=CL.stage_retention(bronze, languages, min_length),
        clean_balance=P.class_balance(cleaned),
        split_balance=P.class_balance(splits, by=["split"]),
    )


@dataclass(frozen=True)
class Analysis:
    balance: DataFrame
    balance_by_split: DataFrame
    length_describe: DataFrame
    length_p99: DataFrame
    length_histogram: DataFrame
    duplicates: DataFrame


def analyze(spark: SparkSession, interim_path: str, split_path: str) -> Analysis:
    """Tables and plot data of the cleaned dataset. Lengths are computed in one scan of the texts."""
    cleaned = A.scan_interim(spark, interim_path)
    tagged = P.with_label_name(P.tag_split(cleaned, A.scan_code_only(spark, split_path), missing=True))
    counts_path = scratch_path(spark, "length-counts")
    P.length_counts(P.length_features(P.with_label_name(cleaned))).write.parquet(counts_path)
    counts = spark.read.parquet(counts_path)
    return Analysis(
        balance=P.class_balance(P.with_label_name(cleaned), "label_name"),
        balance_by_split=P.balance_by_split(tagged),
        length_describe=P.length_describe(counts),
        length_p99=P.length_quantile(counts),
        length_histogram=P.length_histogram(counts),
        duplicates=CL.duplicate_count(cleaned),
    )


def tokenize(
    spark: SparkSession, split_path: str, out_path: str, vocab_path: str, max_length: int = C.MAX_TOKENS,
    vocab_size: int = K.VOCABULARY,
) -> DataFrame:
    """Encode all splits with the vocabulary of the train split; returns the length summary."""
    splits = A.scan_splits(spark, split_path)
    K.build_vocab(splits.where("split = 'train'"), vocab_size).write.mode("overwrite").parquet(vocab_path)
    encoded = K.encode_ids(K.tokenize(splits, max_length), spark.read.parquet(vocab_path))
    A.write_tokenized(encoded, out_path)
    stored = A.scan_tokenized(spark, out_path).withColumn("n_tokens", F.size("input_ids"))
    return K.token_length_summary(stored, max_length)


def train(
    spark: SparkSession, split_path: str, run_dir: str, config: MO.RunConfig = MO.RunConfig(),
    candidates: Sequence[MO.Candidate] = MO.DEFAULT_CANDIDATES, limit_train: int | None = None,
    limit_validation: int | None = None, run_id: str = "run", encoded: bool = False,
) -> MO.Selection:
    """Fit the candidates on train, choose on validation, save the best.

    ``encoded``: ``split_path`` is a table that `tokenize` has stored, and the model reads its ids; texts aren't tokenized again.
    """
    seed = config.random_seed
    train_rows = SP.subsample(_split_rows(spark, split_path, ["train"], encoded), limit_train, seed)
    val_rows = SP.subsample(_split_rows(spark, split_path, ["validation"], encoded), limit_validation, seed)
    source = "input_ids" if encoded else "code"
    return MO.select_best_model(train_rows, val_rows, config, candidates, run_dir, run_id, source)


def _split_rows(spark: SparkSession, path: str, splits: Sequence[str], encoded: bool) -> DataFrame:
    if not encoded:
        return A.scan_splits(spark, path, splits)
    rows = A.scan_tokenized(spark, path, splits).withColumn("split", F.col("split").cast("string"))
    return rows.where(F.col("split").isin(*splits))


@dataclass(frozen=True)
class Evaluation:
    bundle: DataFrame
    confusion: DataFrame
    per_class: DataFrame
    roc: DataFrame


def _measured(scores: M.Scores, limit: float) -> Evaluation:
    return Evaluation(
        bundle=stored(M.metric_bundle(scores, limit), "bundle"),
        confusion=M.confusion_matrix(scores, limit),
        per_class=M.per_class_prf(scores, limit),
        roc=M.roc_curve(scores),
    )


def evaluate(
    spark: SparkSession, split_path: str, run_dir: str, predictions_path: str, metrics_path: str | None = None,
    split: str = "test", threshold: float | None = None,
) -> Evaluation:
    """Score one split, store the predictions, and measure them. All measures come from one table of scores."""
    model, config = A.load_model(spark, run_dir)
    limit = MO.effective_threshold(threshold, config)
    scored = MO.score(A.scan_split(spark, split_path, split), model, limit)
    scored.select("row_id", "label", "prob_ai", "prediction").write.mode("overwrite").parquet(predictions_path)
    scores = M.score_table(spark.read.parquet(predictions_path))
    M.validate_predictions(scores)
    out = _measured(scores, limit)
    if metrics_path:
        A.write_metrics(out.bundle, metrics_path)
    return out


#: Name of the group of all splits together.
ALL = "all"


def evaluate_splits(
    spark: SparkSession, split_path: str, run_dir: str, predictions_path: str, metrics_path: str | None = None,
    splits: Sequence[str] = C.SPLITS, threshold: float | None = None, encoded: bool = False,
) -> Evaluation:
    """Score several splits in one pass and measure each, and `ALL` of them together.

    Predictions are stored by split; the splits are told apart in one table of scores, and the overall measures come from a second
    grouping of it. Every table of the result has a column ``split``. Reports are written below ``metrics_path``, one per split.
    ``encoded`` as in `train`.
    """
    model, config = A.load_model(spark, run_dir)
    limit = MO.effective_threshold(threshold, config)
    rows = _split_rows(spark, split_path, splits, encoded)
    scored = MO.score(rows, model, limit).select("row_id", "label", "prob_ai", "prediction", "split")
    scored.write.mode("overwrite").partitionBy("split").parquet(predictions_path)
    predictions = spark.read.parquet(predictions_path).withColumn("split", F.col("split").cast("string"))
    scores = M.score_table(predictions, by=["split"], overall=ALL)
    M.validate_predictions(M.Scores(scores.table.where(F.col("split") == ALL)))
    out = _measured(scores, limit)
    if metrics_path:
        for name in (*splits, ALL):
            A.write_metrics(out.bundle.where(F.col("split") == name).drop("split"), f"{metrics_path}/{name}")
    return out


def analyze_errors(
    spark: SparkSession, predictions_path: str, split_path: str, split: str = "test", csv_path: str | None = None,
    summary_path: str | None = None, n: int | None = C.MAX_ERROR_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """(top errors, summary) from stored predictions; nothing is scored again. ``n`` None: all errors, in order.

    Predictions and texts are joined once, without the texts; those of the errors that are shown are fetched afterwards.
    """
    snippets = A.scan_split(spark, split_path, split).select("row_id", "code")
    predictions = spark.read.parquet(predictions_path)
    if "split" in predictions.columns:  # those of several splits
        predictions = predictions.where(F.col("split") == split).drop("split")
    table = E.error_rows(predictions, snippets)
    top, summary = table.top(n), stored(table.summary(), "summary")
    if csv_path:
        A.write_error_rows(top, csv_path, n)
    if summary_path:
        A.write_error_summary(summary, summary_path)
    return top, summary


def classify_files(
    spark: SparkSession, path: str, run_dir: str, threshold: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """(verdicts, rejects) for every text file below ``path``."""
    model, config = A.load_model(spark, run_dir)
    snippets, rejects = A.scan_text_files(spark, path)
    limit = MO.effective_threshold(threshold, config)
    return MO.verdicts(snippets, model, limit, config["max_tokens"]), rejects


def compare_runs(spark: SparkSession, reports_dir: str) -> DataFrame:
    """Nine report rows per saved bundle, one column per measure name, one row per run."""
    bundles = A.parse_metrics(A.scan_metric_files(spark, reports_dir))
    long = M.metrics_to_long(bundles, by=["name"])
    return long.groupBy("name").pivot("metric", list(M.REPORT_ROWS)).agg(F.first("value")).orderBy("name")


def list_reports(spark: SparkSession, reports_dir: str) -> DataFrame:
    """(name, kind, n_rows) of everything saved below a folder, error lists included."""
    return A.scan_reports(spark, reports_dir).select("name", "kind", "n_rows").orderBy("name")
