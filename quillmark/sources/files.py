"""Raw files of unknown layout as DataFrames.

All text files of a format are read by one scan, whatever their columns: a row becomes a map from its file's column names to
their text. What a file's columns are, and how a ``.json`` file is to be read, is found by aggregates over the rows, so a plan has a
branch for each format, not for each file or layout, and every text is parsed once. Files disagree on types, so values stay
text; labels are interpreted later, per file. Parquet files keep their types and are read by one scan per schema.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark import constants as C
from quillmark.session import stored

SOURCE_FILE, BLOCK, SEQ = "__source_file", "__block", "__seq"
META = (SOURCE_FILE, BLOCK, SEQ)
#: The row's values by column name, as text.
FIELDS = "__fields"

_CSV = {"header": "false", "escape": '"', "multiLine": "true"}
_SEPARATORS = {"csv": ",", "tsv": "\t"}
_LINES = ("jsonl", "ndjson")
#: Columns that delimited files are read with; the next number is taken only where a header is longer.
WIDTHS = (64, 1024)
# Up to this many files a table with a row for each is broadcast.
BROADCAST_FILES = 500_000


def _glob(suffixes: Sequence[str]) -> str:
    return "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes) + "}"


def _root(path: str) -> str:
    """Path part of a folder name, as it appears inside full file names."""
    return re.sub(r"^[a-z0-9]+:(//[^/]*)?", "", path).rstrip("/")


def _relative(full: Column, root: str) -> Column:
    inner = _root(root)
    return F.substring(full, F.locate(inner, full) + F.lit(len(inner) + 1), F.length(full))


def source_file(root: str) -> Column:
    """Path of the row's file relative to ``root``."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return _relative(decoded, root)


def _position(root: str) -> list[Column]:
    """File and place of a row. The id grows inside a block; only its order there is used."""
    return [
        source_file(root).alias(SOURCE_FILE),
        F.col("_metadata.file_block_start").alias(BLOCK),
        F.monotonically_increasing_id().alias(SEQ),
    ]


def discover_files(spark: SparkSession, root: str, suffixes: Sequence[str] = C.SUFFIXES, glob: str | None = None) -> DataFrame:
    """(path, relative_path, suffix, length) of all supported files below ``root``. Contents stay unread."""
    try:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob or _glob(suffixes))
            .load(root)
        )
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"no such folder: {root}") from e
        raise
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select("path", _relative(F.col("path"), root).alias("relative_path"), suffix.alias("suffix"), "length")


def _below(spark: SparkSession, glob: str):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)


def per_file(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of a stored table that has one row for each file."""
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_FILES else table, SOURCE_FILE, how)


# --- CSV and TSV ----------------------------------------------------------------


@F.arrow_udf(T.BooleanType())
def _first_of_file(files: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Whether a row is the first of its file, in a scan that reads each file whole and in order."""
    last = pa.nulls(1, pa.string())
    for names in files:
        if not len(names):
            yield pa.array([], pa.bool_())
            continue
        before = pa.concat_arrays([last, names[:-1].cast(pa.string())])
        yield pc.fill_null(pc.not_equal(names.cast(pa.string()), before), True)
        last = names[-1:].cast(pa.string())


def _cells(spark: SparkSession, root: str, glob: str, sep: str, width: int) -> DataFrame:
    """Records as cells c0, c1, ...; the first of each file is its header. Quoted line breaks and doubled quotes are read."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width + 1)])
    raw = _below(spark, glob).options(**_CSV, sep=sep).schema(schema).csv(root)
    rows = raw.select("*", *_position(root))
    return rows.withColumn("__header", _first_of_file(F.col(SOURCE_FILE)).cast("int"))


def scan_delimited(spark: SparkSession, root: str, glob: str, sep: str) -> tuple[DataFrame, DataFrame]:
    """(rows, names) of all delimited files that ``glob`` picks: (META, fields), and (file, names) with their columns.

    One grammar for files of any size; a file is read by one task, as a stream. The usual missing-value words are NULL. Of names
    equal but for case the last stands; columns without a name are left out. A file without any line has no columns.
    """
    for width in WIDTHS:
        raw = stored(_cells(spark, root, glob, sep, width), "cells", "__header")
        headers = raw.where("__header = 1")
        if headers.where(F.col(f"c{width}").isNotNull()).isEmpty():
            break
    else:
        raise ValueError(f"a header below {root} has more than {WIDTHS[-1]} columns")
    cells = F.array(*[f"c{i}" for i in range(width)])
    mark = F.regexp_replace("c0", "^﻿", "")
    named = F.transform(
        F.array(mark, *[f"c{i}" for i in range(1, width)]), lambda x, i: F.struct(F.lower(x).alias("low"), x.alias("name"), i.alias("at"))
    )
    filled = F.filter(named, lambda s: F.coalesce(s["name"], F.lit("")) != "")
    columns = F.filter("named", lambda s: ~F.exists(F.col("named"), lambda t: (t["low"] == s["low"]) & (t["at"] > s["at"])))
    layout = stored(headers.select(SOURCE_FILE, filled.alias("named")).select(SOURCE_FILE, columns.alias("columns")), "headers")

    def value(s: Column) -> Column:
        cell = F.get(F.col("cells"), s["at"])
        return F.struct(s["name"], F.when(~cell.isin(*C.NA_TOKENS), cell))

    rows = per_file(raw.where("__header = 0").select(*META, cells.alias("cells")), layout)
    rows = rows.select(*META, F.map_from_entries(F.transform("columns", value)).alias(FIELDS))
    return rows, layout.select(SOURCE_FILE, F.transform("columns", lambda s: s["name"]).alias("names"))


# --- JSON -----------------------------------------------------------------------

_MAP, _ARRAY = "map<string,string>", "array<map<string,string>>"


def _lines(spark: SparkSession, root: str, glob: str) -> DataFrame:
    raw = _below(spark, glob).text(root)
    return raw.select("value", *_position(root)).where(F.length(F.trim("value")) > 0)


def _containers(fields: Column | str) -> Column:
    """Whether all values of a parsed record are themselves objects or arrays, so that it is a document of columns."""
    values = F.map_values(fields)
    nested = F.forall(values, lambda v: F.coalesce(F.from_json(v, _MAP).isNotNull() | F.from_json(v, "array<string>").isNotNull(), F.lit(False)))
    return (F.size(values) > 0) & nested


def json_kinds(lines: DataFrame) -> DataFrame:
    """(file, kind): ``lines``, or what must be read whole: an ``array``, a document of ``columns``, or ``object``, one or the other."""
    first = lines.groupBy(SOURCE_FILE).agg(
        F.min_by("value", F.struct(BLOCK, SEQ)).alias("first"), F.count("*").alias("n")
    )
    start = F.ltrim("first", F.lit("﻿ \t\r\n"))
    record = F.from_json(start, _MAP)
    kind = (
        F.when(F.startswith(start, F.lit("[")), "array")
        .when(record.isNotNull() & (F.col("n") == 1) & _containers(record), "columns")
        .when(F.startswith(start, F.lit("{")) & record.isNull() & (F.col("n") > 1), "object")
        .otherwise("lines")
    )
    return first.select(SOURCE_FILE, kind.alias("kind"))


def _documents(lines: DataFrame) -> DataFrame:
    """(file, block, seq, value): the lines of each file as one text."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(BLOCK, SEQ, "value"))), lambda x: x["value"]), "\n")
    zero = F.lit(0).cast("bigint")
    return lines.groupBy(SOURCE_FILE).agg(whole.alias("value")).select(SOURCE_FILE, zero.alias(BLOCK), zero.alias(SEQ), "value")


class _Json:
    """The ``.json`` files of a folder, told apart and parsed, with what can't be parsed."""

    def __init__(self, spark: SparkSession, root: str, glob: str):
        lines = _lines(spark, root, glob)
        kinds = stored(json_kinds(lines), "kinds")
        if kinds.where("kind <> 'lines'").isEmpty():
            self.lines, self.arrays, self.columns = lines, None, None
            return
        tagged = per_file(lines, kinds)
        whole = stored(_documents(tagged.where("kind IN ('array', 'columns', 'object')")), "documents")
        objects = per_file(whole, kinds.where("kind <> 'array'"))
        told = objects.select(SOURCE_FILE, _containers(F.from_json("value", _MAP)).alias("is_columns"))
        told = stored(told.select(SOURCE_FILE, F.when(F.col("is_columns"), "columns").otherwise("lines").alias("told")), "told")
        kinds = per_file(kinds, told, "left").select(SOURCE_FILE, F.coalesce("told", "kind").alias("kind"))
        kinds = stored(kinds, "kinds")
        self.lines = per_file(lines, kinds.where("kind = 'lines'").drop("kind"))
        self.arrays, self.columns = (per_file(whole, kinds.where(F.col("kind") == k).drop("kind")) for k in ("array", "columns"))

    def rows(self, unreadable: str) -> DataFrame:
        rows = _line_rows(self.lines, unreadable)
        if self.arrays is None:
            return rows
        records = self.arrays.select(
            SOURCE_FILE, BLOCK, F.posexplode(_readable(F.from_json("value", _ARRAY), unreadable)).alias("pos", FIELDS)
        )
        arrays = records.select(SOURCE_FILE, BLOCK, F.col("pos").cast("bigint").alias(SEQ), FIELDS)
        return rows.unionByName(arrays).unionByName(_column_document_rows(self.columns))

    def unreadable(self) -> DataFrame:
        bad = self.lines.where(F.from_json("value", _MAP).isNull())
        if self.arrays is not None:
            bad = bad.unionByName(self.arrays.where(F.from_json("value", _ARRAY).isNull()))
        return bad.select(*META, F.col("value").alias("raw"))


def _readable(parsed: Column, unreadable: str) -> Column:
    """Parsed JSON; what can't be parsed raises, unless it is to be skipped (then it is NULL)."""
    if unreadable == "skip":
        return parsed
    if unreadable != "raise":
        raise ValueError(f"unreadable must be 'raise' or 'skip', not {unreadable!r}")
    return F.coalesce(parsed, F.raise_error(F.concat(F.lit("unreadable JSON in "), F.col(SOURCE_FILE))))


def _line_rows(lines: DataFrame, unreadable: str) -> DataFrame:
    parsed = _readable(F.from_json("value", _MAP), unreadable)
    return lines.select(*META, parsed.alias(FIELDS)).where(F.col(FIELDS).isNotNull())


def _column_document_rows(whole: DataFrame) -> DataFrame:
    """Rows of documents {column: {index: value}} or {column: [value]}, regrouped by index."""
    columns = whole.select(SOURCE_FILE, BLOCK, F.explode(F.from_json("value", _MAP)).alias("name", "cells"))
    listed = F.substring(F.ltrim("cells"), 1, 1) == "["
    arrays = columns.where(listed).select(
        SOURCE_FILE, BLOCK, "name", F.posexplode(F.from_json("cells", "array<string>")).alias("pos", "cell")
    ).withColumn("index", F.col("pos").cast("string"))
    maps = columns.where(~listed).select(
        SOURCE_FILE, BLOCK, "name", F.posexplode(F.from_json("cells", _MAP)).alias("pos", "index", "cell")
    )
    cells = maps.unionByName(arrays)
    rows = cells.groupBy(SOURCE_FILE, BLOCK, "index").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "cell"))).alias(FIELDS), F.min("pos").cast("bigint").alias(SEQ)
    )
    return rows.select(*META, FIELDS)


def scan_json_lines(spark: SparkSession, root: str, glob: str, unreadable: str = "raise") -> DataFrame:
    """(META, fields) of files with a record on each line. Keys keep their case, values their text."""
    return _line_rows(_lines(spark, root, glob), unreadable)


def scan_json(spark: SparkSession, root: str, glob: str, unreadable: str = "raise") -> DataFrame:
    """(META, fields) of JSON files that hold lines, one array, or one document of columns each; told by their content.

    Lines may be of any number. An array or a document of columns is one text in one task.
    """
    return _Json(spark, root, glob).rows(unreadable)


def unreadable_json(spark: SparkSession, root: str) -> DataFrame:
    """(file, block, seq, raw) of all JSON below ``root`` that ``unreadable="skip"`` leaves out: lines, or whole documents."""
    lines = _lines(spark, root, _glob(_LINES)).where(F.from_json("value", _MAP).isNull())
    return _Json(spark, root, _glob(["json"])).unreadable().unionByName(lines.select(*META, F.col("value").alias("raw")))


# --- All text files ----------------------------------------------------------------


def text_rows(spark: SparkSession, root: str, suffixes: Sequence[str], unreadable: str = "raise", glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, files) of all text files: (META, fields), parsed and stored, and (file, names, words).

    ``names`` are a file's columns: those of its header, or the keys that any record has, in alphabetical order; ``words`` those of
    them that may be labels and have a value which isn't a number.
    """
    wanted = lambda *names: [s for s in names if s in suffixes]
    rows = named = None
    for suffix in wanted(*_SEPARATORS):
        scanned, names = scan_delimited(spark, root, glob or _glob([suffix]), _SEPARATORS[suffix])
        rows = scanned if rows is None else rows.unionByName(scanned)
        named = names if named is None else named.unionByName(names)
    json = []
    if wanted("json"):
        json.append(scan_json(spark, root, glob or _glob(["json"]), unreadable))
    if wanted(*_LINES):
        json.append(scan_json_lines(spark, root, glob or _glob(wanted(*_LINES)), unreadable))
    for frame in json:
        frame = stored(frame, "records")
        rows = frame if rows is None else rows.unionByName(frame)
    return rows, _files(rows, named)


def _files(rows: DataFrame, named: DataFrame | None) -> DataFrame:
    """(file, names, words) from rows, and from the names that headers give. Key sets are merged in tasks."""

    def union_of(sets: Column) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(sets))))

    def is_word(name: Column, value: Column) -> Column:
        return F.lower(name).isin(*C.LABEL_COLUMNS) & value.isNotNull() & value.try_cast("double").isNull()

    found = rows.groupBy(SOURCE_FILE).agg(
        union_of(F.map_keys(FIELDS)).alias("names"), union_of(F.map_keys(F.map_filter(FIELDS, is_word))).alias("words")
    )
    if named is not None:
        headers = named.select(SOURCE_FILE, F.col("names").alias("header"))
        found = found.join(headers, SOURCE_FILE, "full").select(
            SOURCE_FILE, F.coalesce("header", "names").alias("names"), F.coalesce("words", F.array().cast("array<string>")).alias("words")
        )
    return stored(found, "files")


# --- Parquet ----------------------------------------------------------------------


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(re.sub(r"^s3a:", "s3:", path))


def _schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for pdf in batches:
        found = []
        for path in pdf["path"]:
            try:
                filesystem, name = _open(path)
                # Types are part of it: the same name may be text in one file, a number in another.
                found.append("\n".join(f"{f.name}\t{f.type}" for f in pq.read_schema(name, filesystem=filesystem)))
            except (pa.ArrowInvalid, ValueError):  # a store that only Spark's readers know
                found.append(None)
        yield pd.DataFrame({"path": pdf["path"], "schema": found})


def _escaped(paths: Sequence[str]) -> list[str]:
    """Paths with glob characters made literal."""
    return [re.sub(r"([{}\[\]*?\\])", r"\\\1", p) for p in paths]


def _last_of_case(names: Sequence[str]) -> list[str]:
    """Names, of those that differ only in case the last."""
    return list({name.lower(): name for name in names}.values())


def parquet_frames(spark: SparkSession, root: str, glob: str | None = None) -> list[DataFrame]:
    """Parquet files below ``root``, one table for each schema, with file and position."""
    files = discover_files(spark, root, ["parquet"], glob)
    known = files.select("path").mapInPandas(_schemas, "path string, schema string")
    # One row for each schema; Spark's readers need the file names of each.
    groups = known.groupBy("schema").agg(F.sort_array(F.collect_list("path")).alias("paths")).orderBy("paths").collect()
    kinds = [[p] for g in groups if g["schema"] is None for p in g["paths"]] + [g["paths"] for g in groups if g["schema"] is not None]
    frames = []
    for paths in kinds:
        frame = spark.read.parquet(*_escaped(paths))
        names = _last_of_case(frame.columns)
        frames.append(frame.select(*[F.col(f"`{n}`") for n in names], *_position(root)))
    return frames


# --- All files ---------------------------------------------------------------------


def found_suffixes(spark: SparkSession, root: str, glob: str | None = None) -> list[str]:
    """Kinds of files there are below ``root``; none is an error."""
    kinds = [r["suffix"] for r in discover_files(spark, root, glob=glob).select("suffix").distinct().collect()]
    if not kinds:
        raise FileNotFoundError(f"no supported files ({', '.join(C.SUFFIXES)}) below {root}")
    return [s for s in C.SUFFIXES if s in kinds]


def _spelled(files: DataFrame) -> dict[str, list[str]]:
    """The spellings of each column name, last first, by the name in lower case; in the order of the files that have it."""
    each = files.select(SOURCE_FILE, F.posexplode("names").alias("at", "name"))
    names = each.groupBy(F.lower("name").alias("low")).agg(
        F.sort_array(F.collect_set("name"), asc=False).alias("spellings"), F.min(F.struct(SOURCE_FILE, "at")).alias("seen")
    )
    # As many rows as the united table has columns.
    return {r["low"]: r["spellings"] for r in names.orderBy("seen").collect()}


def as_text(df: DataFrame) -> DataFrame:
    """All columns but the position cast to STRING, so that files with unlike types can be united."""
    return df.select(*[F.col(f"`{c}`") if c in META else F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


def union_files(spark: SparkSession, root: str, unreadable: str = "raise", glob: str | None = None) -> DataFrame:
    """All files below ``root`` by column name, absent columns NULL, everything STRING.

    Names that differ only in case are one column. JSON that can't be read is an error; with ``unreadable="skip"`` it is left out,
    and `unreadable_json` has it. No rows, and only the position's columns, where nothing can be read.
    """
    suffixes = found_suffixes(spark, root, glob)
    frames = []
    if any(s != "parquet" for s in suffixes):
        rows, files = text_rows(spark, root, suffixes, unreadable, glob)
        values = [
            F.coalesce(*[F.try_element_at(FIELDS, F.lit(n)) for n in spelled]).alias(spelled[-1])
            for spelled in _spelled(files).values()
        ]
        frames.append(rows.select(*values, *META))
    if "parquet" in suffixes:
        frames += [as_text(f) for f in parquet_frames(spark, root, glob)]
    united = frames[0]
    for frame in frames[1:]:
        united = united.unionByName(frame, allowMissingColumns=True)
    return united


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as a table of its columns; an unknown suffix is an error."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in C.SUFFIXES:
        raise ValueError(f"unsupported file type {suffix!r}: {path}")
    folder, name = path.rsplit("/", 1)
    glob = re.sub(r"([{}\[\]*?\\,])", r"\\\1", name)
    if discover_files(spark, folder, glob=glob).isEmpty():
        raise FileNotFoundError(path)
    if suffix == "parquet":
        return next(iter(parquet_frames(spark, folder, glob))).drop(*META)
    return union_files(spark, folder, glob=glob).drop(*META)
