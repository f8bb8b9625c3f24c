"""Tables and files the phases leave on disk: readers and writers."""

from __future__ import annotations

import re

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark import constants as C
from quillmark.functions import text as X
from quillmark.operators import errors as E
from quillmark.operators import metrics as M
from quillmark.operators import tokens as K
from quillmark.sources import files as S
from quillmark.sources import versions as V

_CLASS = T.StructType(
    [T.StructField(f, T.DoubleType()) for f in ("precision", "recall", "f1")] + [T.StructField("support", T.LongType())]
)

METRICS_SCHEMA = T.StructType(
    [
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("macro_f1", T.DoubleType()),
        T.StructField("auc_roc", T.DoubleType()),
        T.StructField("per_class", T.MapType(T.StringType(), _CLASS)),
        T.StructField("confusion_matrix", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("support", T.MapType(T.StringType(), T.LongType())),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("n_samples", T.LongType()),
    ]
)

SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("n_test", T.LongType()),
        T.StructField("n_errors", T.LongType()),
        T.StructField("error_rate", T.DoubleType()),
        T.StructField("errors_by_true_class", T.MapType(T.StringType(), T.LongType())),
        T.StructField("errors_by_predicted_class", T.MapType(T.StringType(), T.LongType())),
        T.StructField("mean_confidence_on_errors", T.DoubleType()),
        T.StructField("median_confidence_on_errors", T.DoubleType()),
        T.StructField(
            "length_stats",
            T.StructType(
                [
                    T.StructField(f, T.DoubleType())
                    for f in ("errors_n_chars_mean", "correct_n_chars_mean", "errors_n_lines_mean", "correct_n_lines_mean")
                ]
            ),
        ),
    ]
)

HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("train_loss", T.DoubleType()),
        T.StructField("val_loss", T.DoubleType()),
        T.StructField("val_metrics", METRICS_SCHEMA),
        T.StructField("learning_rate", T.DoubleType()),  # NULL for fits that have none
        T.StructField("reg_param", T.DoubleType()),
        T.StructField("seconds", T.DoubleType()),
    ]
)


def _read(reader, path: str, missing: str) -> DataFrame:
    try:
        return reader(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            raise FileNotFoundError(f"{missing}: {path}") from e
        raise


# --- Tables -------------------------------------------------------------------


def write_interim(df: DataFrame, path: str) -> None:
    """Cleaned table, replacing an older one, also one that ``df`` is read from."""
    V.replace_table(df, path)


def scan_interim(spark: SparkSession, path: str) -> DataFrame:
    return _read(lambda p: V.read_table(spark, p), path, "no cleaned table")


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split, so that reading one split reads only its files. Replaces an older table, also its own source."""
    V.replace_table(df, path, "split")


def _splits(spark: SparkSession, path: str) -> DataFrame:
    return _read(lambda p: V.read_table(spark, p), path, "no splits")


def scan_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Rows of one split; a split that was never written is an error."""
    table = _splits(spark, path)
    part = table.where(F.col("split") == split)
    if part.select("split").limit(1).count() == 0:
        raise FileNotFoundError(f"no split {split!r} in {path}")
    return part.withColumn("split", F.col("split").cast("string"))


def scan_splits(spark: SparkSession, path: str, splits: Sequence[str] = C.SPLITS) -> DataFrame:
    """Rows of several splits; a split that was never written is an error."""
    table = _splits(spark, path)
    named = table.withColumn("split", F.col("split").cast("string")).where(F.col("split").isin(*splits))
    # As many rows as there are splits.
    missing = set(splits) - {r[0] for r in named.select("split").distinct().collect()}
    if missing:
        raise FileNotFoundError(f"no split {', '.join(sorted(missing))} in {path}")
    return named


def scan_code_only(spark: SparkSession, path: str) -> DataFrame:
    """Text and split only; no other column is read."""
    return _splits(spark, path).select("code", F.col("split").cast("string").alias("split"))


def write_tokenized(df: DataFrame, path: str) -> None:
    K.keep_token_columns(df, [c for c in ("row_id", "split") if c in df.columns]).write.mode("overwrite").partitionBy(
        "split"
    ).parquet(path)


def scan_tokenized(spark: SparkSession, path: str, splits: Sequence[str] = C.SPLITS) -> DataFrame:
    """Token table; every required split must have rows."""
    table = _read(spark.read.parquet, path, "no tokenized table")
    found = {r[0] for r in table.select("split").distinct().collect()}
    missing = [s for s in splits if s not in found]
    if missing:
        raise ValueError(f"tokenized table lacks splits {missing}; it has {sorted(map(str, found))}")
    return table


def scan_text_files(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(snippets, rejects): every file below ``path`` as one text; blank files are rejected rows."""
    read = spark.read.option("recursiveFileLookup", "true")
    files = _read(lambda p: read.text(p, wholetext=True), path, "no such file or folder")
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("code"))
    blank = F.length(X.strip("code")) == 0
    return rows.where(~blank), rows.where(blank).select("file", F.lit("empty or whitespace only").alias("reason"))


# --- Reports --------------------------------------------------------------------


def write_metrics(flat: DataFrame, path: str) -> None:
    """One bundle as a JSON document (one row, so one file)."""
    M.nested_bundle(flat).coalesce(1).write.mode("overwrite").json(path)


def write_error_summary(flat: DataFrame, path: str) -> None:
    E.nested_summary(flat).coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


# --- Fixed values: header of the error report -------------------------------
ERROR_COLUMNS = (
    "code", "label", "label_name", "prediction", "prediction_name", "prob_ai", "is_correct", "n_chars", "n_lines", "confidence",
)


def write_errors_csv(df: DataFrame, path: str, n: int | None = C.MAX_ERROR_ROWS) -> None:
    """First ``n`` errors of an `error_table`, in order; ``n`` is small, so one file. None: all, as parts in order of their names."""
    write_error_rows(E.rank_errors(df) if n is None else E.top_errors(df, n), path, n)


def write_error_rows(rows: DataFrame, path: str, n: int | None) -> None:
    """Errors that are already chosen and in order, with header; one file unless ``n`` is None."""
    shown = rows.select(*ERROR_COLUMNS)
    shown = shown if n is None else shown.coalesce(1)
    shown.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def scan_metric_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, payload): every JSON document below ``path``, told apart by its fields.

    A document is a ``*.json`` file, or a folder Spark wrote. Its name is the way to it from ``path``, so that no two
    documents share one.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("payload"))
        .where(F.col("payload") != "")
    )
    root = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/+", "", path).strip("/")
    name = F.regexp_replace(F.substring_index(F.concat(F.lit("/"), "file"), f"/{root}/", -1), r"(?:^|/)part-[^/]*$", "")
    # a folder that is itself a document is named by itself
    name = F.when(name == "", root.rsplit("/", 1)[-1]).otherwise(name)

    def has(field: str):
        return F.array_contains(F.json_object_keys("payload"), field)

    kind = F.when(has("accuracy") & has("per_class"), "metrics").when(has("n_errors"), "error_summary").otherwise("raw")
    return files.select(F.regexp_replace(name, r"\.json$", "").alias("name"), kind.alias("kind"), "payload")


def scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, n_rows, payload): every JSON document, and every CSV table with a header, below ``path``.

    A CSV file's kind is ``errors`` if its header is that of the error report, else ``csv``; ``n_rows`` counts its records, and those
    of a folder Spark wrote together. JSON documents have no row count, CSV tables no payload.
    """
    suffixes = {r["suffix"] for r in S.discover_files(spark, path, ["json", "csv"]).select("suffix").distinct().collect()}
    if not suffixes:
        raise FileNotFoundError(f"no reports below {path}")
    columns = "name string, kind string, n_rows bigint, payload string"
    found = spark.createDataFrame([], columns)
    if "json" in suffixes:
        documents = scan_metric_files(spark, path)
        found = found.unionByName(documents.withColumn("n_rows", F.lit(None).cast("bigint")))
    if "csv" in suffixes:
        rows, headers = S.scan_delimited(spark, path, "*.[cC][sS][vV]", ",")
        counts = rows.groupBy(S.SOURCE_FILE).agg(F.count("*").alias("n"))
        files = headers.join(counts, S.SOURCE_FILE, "left")
        name = F.regexp_replace(F.regexp_replace(S.SOURCE_FILE, r"/part-[^/]*$", ""), r"\.[cC][sS][vV]$", "")
        # a folder that is itself a table is named by itself
        name = F.when(F.startswith(S.SOURCE_FILE, F.lit("part-")), path.rstrip("/").rsplit("/", 1)[-1]).otherwise(name)
        is_errors = F.col("names") == F.array(*map(F.lit, ERROR_COLUMNS))
        kind = F.when(F.bool_and(is_errors), "errors").otherwise("csv")
        tables = files.groupBy(name.alias("name")).agg(kind.alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"))
        found = found.unionByName(tables.withColumn("payload", F.lit(None).cast("string")))
    return found


def parse_metrics(documents: DataFrame) -> DataFrame:
    """Flat bundles of the metric documents."""
    b = documents.where("kind = 'metrics'").select("name", F.from_json("payload", METRICS_SCHEMA).alias("b"))
    fields = ("precision", "recall", "f1", "support")
    return b.select(
        "name", "b.accuracy", "b.macro_f1", "b.auc_roc",
        *[F.col("b.per_class")[c][f].alias(f"{f}_{c}") for c in C.LABEL_NAMES.values() for f in fields],
        "b.threshold", "b.n_samples",
    )


# --- Training artefacts -----------------------------------------------------------


def write_history(history: DataFrame, run_dir: str) -> None:
    """Records of all epochs so far, replacing those of before."""
    path = f"{run_dir}/training_history"
    version, folder = V.new_version(path)
    history.write.json(folder)
    V.publish(history.sparkSession, path, version)


def scan_history(spark: SparkSession, run_dir: str) -> DataFrame:
    """Per-epoch records of a run; no rows if it has none."""
    try:
        return spark.read.schema(HISTORY_SCHEMA).json(V.current(spark, f"{run_dir}/training_history"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], HISTORY_SCHEMA)


def write_selection(spark: SparkSession, key: str, run_dir: str) -> None:
    """Name what is being selected from, for `scan_selection` after a restart."""
    V.replace_table(spark.range(1).select(F.lit(key).alias("key")), f"{run_dir}/selection")


def scan_selection(spark: SparkSession, run_dir: str) -> str | None:
    try:
        return V.read_table(spark, f"{run_dir}/selection").first()["key"]
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


CONFIG_SCHEMA = T.StructType(
    [
        T.StructField("num_features", T.IntegerType()),
        T.StructField("max_tokens", T.IntegerType()),
        T.StructField("decision_threshold", T.DoubleType()),
        T.StructField("early_stop_patience", T.IntegerType()),
        T.StructField("random_seed", T.IntegerType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)


def write_config(spark: SparkSession, config: dict, run_dir: str) -> None:
    row = spark.createDataFrame([tuple(config[f.name] for f in CONFIG_SCHEMA)], CONFIG_SCHEMA)
    row.coalesce(1).write.mode("overwrite").json(f"{run_dir}/training_config")


def scan_config(spark: SparkSession, run_dir: str) -> DataFrame:
    """The run's settings as one row; a missing ``extra`` is empty."""
    read = spark.read.schema(CONFIG_SCHEMA).json
    row = _read(read, f"{run_dir}/training_config", "no training run")
    empty = F.create_map().cast("map<string,string>")
    return row.withColumn("extra", F.coalesce("extra", empty))


def save_model(model: PipelineModel, run_dir: str) -> None:
    """Save a model in place of an older one, which counts until this one is complete."""
    path = f"{run_dir}/model"
    version, folder = V.new_version(path)
    model.write().save(folder)
    V.publish(SparkSession.active(), path, version)


def load_model(spark: SparkSession, run_dir: str) -> tuple[PipelineModel, dict]:
    """(model, settings) of a saved run."""
    config = scan_config(spark, run_dir).first().asDict()
    return PipelineModel.load(V.current(spark, f"{run_dir}/model")), config
