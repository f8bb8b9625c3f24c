"""From any raw table to (code, label, language)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark import constants as C
from quillmark.functions import text as X
from quillmark.session import stored
from quillmark.sources import files as S


# Order of a row among all rows, before file and position.
PART = "__part"

# Whether a row's label is a number, where files of both kinds are united.
NUMERIC = "__numeric"

# Up to this many files or file blocks a table of them is broadcast.
BROADCAST_BLOCKS = 500_000


def resolve_column(columns: Sequence[str], candidates: Sequence[str], role: str, required: bool = True) -> str | None:
    """First candidate that names a column, ignoring case; of columns equal but for case, the last."""
    by_lower = {c.lower(): c for c in columns}
    for candidate in candidates:
        if candidate.lower() in by_lower:
            return by_lower[candidate.lower()]
    if required:
        raise KeyError(f"no {role} column: looked for {tuple(candidates)} in {list(columns)}")
    return None


def encode_label(
    label: Column | str, kind: T.DataType | str, human: Sequence[str] = C.HUMAN_ALIASES,
    ai: Sequence[str] = C.AI_ALIASES, strict: bool = True,
) -> Column:
    """0/1 from a raw label.

    ``kind`` tells how to read it: a Spark type, or ``"numeric"`` for text that holds numbers. Numbers
    lose their fraction toward zero; words are looked up without case and outer whitespace. Any other
    value raises, or is NULL if not ``strict``.
    """
    raw = X._col(label)
    if isinstance(kind, T.BooleanType):
        code = raw.cast("int")
    elif kind == "numeric" or isinstance(kind, T.NumericType):
        number = raw.try_cast("double")
        whole = F.when(~F.isnan(number), F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)))
        code = F.when(whole.isin(C.HUMAN, C.AI), whole.cast("int"))
    else:
        word = F.lower(X.strip(raw.cast("string")))
        code = F.when(word.isin(*human), C.HUMAN).when(word.isin(*ai), C.AI)
    if not strict:
        return code
    shown = F.coalesce(raw.cast("string"), F.lit("NULL"))
    return F.coalesce(code, F.raise_error(F.concat(F.lit("unrecognized label: "), shown)).cast("int"))


def paired_columns(columns: Sequence[str]) -> tuple[str, str] | None:
    """(human, ai) columns if the table holds pairs."""
    human = resolve_column(columns, C.HUMAN_CODE_COLUMNS, "human code", required=False)
    ai = resolve_column(columns, C.AI_CODE_COLUMNS, "ai code", required=False)
    return (human, ai) if human and ai else None


def paired_to_long(df: DataFrame, human: str, ai: str, keep: Sequence[str] = ()) -> DataFrame:
    """Two rows per pair in one pass; the human rows come first in the order (label, position)."""
    rows = F.stack(F.lit(2), F.col(f"`{human}`"), F.lit(C.HUMAN), F.col(f"`{ai}`"), F.lit(C.AI)).alias("code", "label")
    return df.select(rows, *keep)


def normalize_schema(
    df: DataFrame, label_kind: str | None = None, on_bad_label: str = "error", keep: Sequence[str] = ()
) -> DataFrame:
    """(code STRING, label INT, language STRING, keep...) from a long or a paired table.

    Pairs win over a label column. A missing language column or value is ``unknown``, a missing code is
    NULL. ``label_kind="numeric"`` reads text labels as numbers; a column `NUMERIC` tells it row by row. With ``on_bad_label="quarantine"`` unreadable labels become NULL and ``label_raw`` keeps them.
    """
    if on_bad_label not in ("error", "quarantine"):
        raise ValueError(f"on_bad_label must be 'error' or 'quarantine', not {on_bad_label!r}")
    columns = [c for c in df.columns if c not in (*S.META, NUMERIC, *keep)]
    language = resolve_column(columns, C.LANGUAGE_COLUMNS, "language", required=False)
    language_value = X.normalize_language(F.col(f"`{language}`").cast("string")) if language else F.lit(C.UNKNOWN)
    pair = paired_columns(columns)
    if pair:
        human, ai = pair
        texts = df.select(
            F.col(f"`{human}`").cast("string").alias("_human"), F.col(f"`{ai}`").cast("string").alias("_ai"),
            language_value.alias("language"), *keep,
        )
        out = paired_to_long(texts, "_human", "_ai", ["language", *keep])
        label_raw = F.col("label").cast("string")
        label = F.col("label")
    else:
        code_name = resolve_column(columns, C.CODE_COLUMNS, "code")
        label_name = resolve_column(columns, C.LABEL_COLUMNS, "label")
        kind = label_kind or df.schema[label_name].dataType
        strict = on_bad_label == "error"
        flag = [NUMERIC] if NUMERIC in df.columns else []
        out = df.select(
            F.col(f"`{code_name}`").cast("string").alias("code"), F.col(f"`{label_name}`").alias("_raw"),
            language_value.alias("language"), *keep, *flag,
        )
        label_raw = F.col("_raw").cast("string")
        label = encode_label("_raw", kind, strict=strict)
        if flag:
            label = F.when(F.col(NUMERIC), encode_label("_raw", "numeric", strict=strict)).otherwise(label)
    extra = [label_raw.alias("label_raw")] if on_bad_label == "quarantine" else []
    return out.select("code", label.cast("int").alias("label"), "language", *extra, *keep)


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good, bad) rows of a table normalized with ``on_bad_label="quarantine"``."""
    return df.where(F.col("label").isNotNull()).drop("label_raw"), df.where(F.col("label").isNull())


def _chosen(names: Column, candidates: Sequence[str]) -> Column:
    """`resolve_column` over an array of names: first candidate that is among them, of names equal but for case the last."""
    return F.coalesce(*[F.try_element_at(F.filter(names, lambda n: F.lower(n) == c), F.lit(-1)) for c in candidates])


def file_columns(files: DataFrame) -> DataFrame:
    """(file, human, ai, code, label, language, numeric) from (file, names, words): the columns each file is read by.

    Names are NULL where a file lacks such a column. ``numeric``: no label of the file is a word. Raises where a file has neither
    pairs nor code and label.
    """
    roles = {
        "human": C.HUMAN_CODE_COLUMNS, "ai": C.AI_CODE_COLUMNS, "code": C.CODE_COLUMNS, "label": C.LABEL_COLUMNS,
        "language": C.LANGUAGE_COLUMNS,
    }
    chosen = files.select(S.SOURCE_FILE, "names", "words", *[_chosen(F.col("names"), c).alias(r) for r, c in roles.items()])
    paired = F.col("human").isNotNull() & F.col("ai").isNotNull()
    for role, names in (("code", C.CODE_COLUMNS), ("label", C.LABEL_COLUMNS)):
        row = chosen.where(~paired & F.col(role).isNull()).select(S.SOURCE_FILE, "names").first()
        if row:
            raise KeyError(f"no {role} column in {row[0]}: looked for {names} in {row['names']}")
    numeric = ~F.coalesce(F.array_contains("words", F.col("label")), F.lit(False))
    return chosen.select(S.SOURCE_FILE, *[F.when(paired | ~F.lit(r in ("human", "ai")), F.col(r)).alias(r) for r in roles], numeric.alias("numeric"))


def canonical_texts(rows: DataFrame, columns: DataFrame, on_bad_label: str = "error") -> DataFrame:
    """(code, label, language, META, part) from rows of text files and `file_columns`, each file by its own columns."""
    with_columns = S.per_file(rows, stored(columns, "columns"))

    def value(role: str) -> Column:
        return F.try_element_at(S.FIELDS, F.col(role))

    def one(code: str, label: Column, of_pair: int | None) -> Column:
        paired = F.lit(of_pair).cast("int")
        return F.struct(value(code).alias("code"), label.alias("raw"), paired.alias("of_pair"))

    nothing = F.lit(None).cast("string")
    pair = F.array(one("human", nothing, C.HUMAN), one("ai", nothing, C.AI))
    single = F.array(one("code", value("label"), None))
    each = with_columns.select(
        F.explode(F.when(F.col("human").isNotNull(), pair).otherwise(single)).alias("r"), "numeric",
        X.normalize_language(value("language")).alias("language"), *S.META,
    )
    strict = on_bad_label == "error"
    read = F.when(F.col("numeric"), encode_label("r.raw", "numeric", strict=strict)).otherwise(encode_label("r.raw", T.StringType(), strict=strict))
    label = F.when(F.col("r.of_pair").isNotNull(), F.col("r.of_pair")).otherwise(read).cast("int")
    raw = F.coalesce("r.raw", F.col("r.of_pair").cast("string"))
    extra = [raw.alias("label_raw")] if on_bad_label == "quarantine" else []
    # Of pairs, all human rows come before all others.
    part = F.coalesce("r.of_pair", F.lit(0)).alias(PART)
    return each.select(F.col("r.code").alias("code"), label.alias("label"), "language", *extra, *S.META, part)


def _flag_numeric_files(raw: DataFrame) -> DataFrame:
    """Add `NUMERIC`: all labels of the row's file are numbers. Pairs have no label to read."""
    columns = [c for c in raw.columns if c not in S.META]
    if paired_columns(columns):
        return raw
    label = F.col(f"`{resolve_column(columns, C.LABEL_COLUMNS, 'label')}`")
    word = label.isNotNull() & label.try_cast("double").isNull()
    kinds = raw.groupBy(S.SOURCE_FILE).agg(F.bool_and(~word).alias(NUMERIC))
    return S.per_file(raw, stored(kinds, "kinds"), "left")


def load_canonical(
    spark: SparkSession, root: str, resolve: str = "file", on_bad_label: str = "error"
) -> DataFrame:
    """Canonical rows of all files below ``root``, with part, file and position.

    ``resolve="file"`` finds the columns of each file by itself. ``"global"`` resolves them once on the
    union of all files, so of files that name their code column differently only one kind keeps its code.
    """
    if on_bad_label not in ("error", "quarantine"):
        raise ValueError(f"on_bad_label must be 'error' or 'quarantine', not {on_bad_label!r}")

    def canonical(frame: DataFrame) -> DataFrame:
        paired = paired_columns([c for c in frame.columns if c not in (*S.META, NUMERIC)])
        out = normalize_schema(frame, None, on_bad_label, list(S.META))
        return out.withColumn(PART, F.col("label") if paired else F.lit(0))

    if resolve == "global":
        return canonical(_flag_numeric_files(S.union_files(spark, root)))
    if resolve != "file":
        raise ValueError(f"resolve must be 'file' or 'global', not {resolve!r}")
    suffixes = S.found_suffixes(spark, root)
    parts = []
    if any(s != "parquet" for s in suffixes):
        rows, files = S.text_rows(spark, root, suffixes)
        parts.append(canonical_texts(rows, file_columns(files), on_bad_label))
    if "parquet" in suffixes:
        parts += [canonical(frame) for frame in S.parquet_frames(spark, root)]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def mint_row_ids(stored: DataFrame) -> DataFrame:
    """Replace part, file and position by a BIGINT ``row_id`` that grows with (part, file, place).

    ``stored`` must be a written table, so that positions no longer change. Only a table with one row
    per file block is windowed; each row adds its place in the block to the block's start. Ids are unique
    and ordered, with gaps where a block has gaps.
    """
    order = [PART, S.SOURCE_FILE, S.BLOCK]
    blocks = stored.groupBy(*order).agg(F.min(S.SEQ).alias("_first"), (F.max(S.SEQ) - F.min(S.SEQ) + 1).alias("_n"))
    files = blocks.groupBy(*order[:-1]).agg(F.sum("_n").alias("_file_n"))
    # One row per file here and per block of a file below.
    all_files = Window.partitionBy(F.lit(0)).orderBy(*order[:-1]).rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy(*order[:-1]).orderBy(S.BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    file_start = files.select(*order[:-1], F.coalesce(F.sum("_file_n").over(all_files), F.lit(0)).alias("_fs"))
    block_start = blocks.withColumn("_bs", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
    starts = block_start.join(file_start, order[:-1]).select(*order, (F.col("_fs") + F.col("_bs") - F.col("_first")).alias("_start"))
    if blocks.count() <= BROADCAST_BLOCKS:
        starts = F.broadcast(starts)
    out = [c for c in stored.columns if c not in (PART, *S.META)]
    return stored.join(starts, order).select(
        (F.col("_start") + F.col(S.SEQ)).alias("row_id"), *out, F.col(S.SOURCE_FILE).alias("source_file")
    )
