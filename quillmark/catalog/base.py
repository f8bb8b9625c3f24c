"""Query registry and the inputs all registered queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.functions import text as X
from quillmark.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Add a query, and the SQL that must give the same rows."""

    def add(query: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """All documents as snippets without label; ``heavy`` deals a small input to all cores."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("text").alias("code"), F.col("lang").alias("language"), "source"
    )
    return spread(rows) if heavy else rows


def attach_label(snippets: DataFrame, labels: DataFrame) -> DataFrame:
    """Snippets that have a label, with it."""
    return snippets.join(labels.select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label")), "row_id")


def snippets(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """(row_id, code, language, source, label) of the labelled documents."""
    return attach_label(documents(spark, sf_dir, heavy), table(spark, sf_dir, "labels"))


def predictions(spark: SparkSession, sf_dir: str, threshold: float = C.THRESHOLD) -> DataFrame:
    """Labelled documents with a score that is a hash of the id, the same in SQL."""
    prob = F.pmod(X.seeded_key(C.SEED, "row_id"), F.lit(1001)) / F.lit(1000.0)
    return snippets(spark, sf_dir).withColumn("prob_ai", prob).withColumn(
        "prediction", (F.col("prob_ai") >= threshold).cast("int")
    )


def r6(*names: str) -> list:
    """Columns rounded to 6 decimals, for comparison with SQL."""
    return [F.round(F.col(n), 6).alias(n) for n in names]


# Named parts of the SQL checks.
DOCS = "docs AS (SELECT doc_id AS row_id, text AS code, lang AS language, source FROM documents)"
SNIPS = (
    "snips AS (SELECT d.doc_id AS row_id, d.text AS code, d.lang AS language, d.source, l.quality AS label "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)


def sql_key(seed: str, row_id: str = "row_id") -> str:
    """The seeded order key in SQL."""
    return f"('0x' || substr(md5('{seed}:' || {row_id}), 1, 15))::BIGINT"


PREDS = (
    f"{SNIPS}, preds AS (SELECT *, (prob_ai >= 0.5)::INTEGER AS prediction FROM "
    f"(SELECT *, ({sql_key('42')} % 1001) / 1000.0::DOUBLE AS prob_ai FROM snips))"
)


def sql_split(source: str, stratum: str, row_id: str = "row_id", seed: str = "42") -> str:
    """CTEs ending in ``parted``: ``source`` with its split, both quota rounds written out."""
    return f"""
    n0 AS (SELECT {stratum} AS s, count(*) AS n FROM {source} GROUP BY ALL),
    t0 AS (SELECT *, sum(n) OVER () AS total FROM n0),
    t1 AS (SELECT *, total - ceil(total * 0.15::DOUBLE) AS keep FROM t0),
    t2 AS (SELECT *, n::DOUBLE / total * keep AS share FROM t1),
    t3 AS (SELECT *, keep - sum(floor(share)) OVER () AS missing,
                  row_number() OVER (ORDER BY share - floor(share) DESC, s) AS place FROM t2),
    t4 AS (SELECT s, n, (floor(share) + (place <= missing)::INT)::BIGINT AS rest FROM t3),
    v0 AS (SELECT *, sum(rest) OVER () AS total FROM t4),
    v1 AS (SELECT *, total - ceil(total * (0.15::DOUBLE / (0.7::DOUBLE + 0.15::DOUBLE))) AS keep FROM v0),
    v2 AS (SELECT *, rest::DOUBLE / total * keep AS share FROM v1),
    v3 AS (SELECT *, keep - sum(floor(share)) OVER () AS missing,
                  row_number() OVER (ORDER BY share - floor(share) DESC, s) AS place FROM v2),
    quotas AS (SELECT s, n, (floor(share) + (place <= missing)::INT)::BIGINT AS n_train,
                      rest - (floor(share) + (place <= missing)::INT)::BIGINT AS n_validation, n - rest AS n_test FROM v3),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {sql_key(seed, row_id)}, {row_id}) - 1 AS r
               FROM {source}),
    parted AS (SELECT ranked.* EXCLUDE (r), CASE WHEN r < n_test THEN 'test'
                      WHEN r < n_test + n_validation THEN 'validation' ELSE 'train' END AS split
               FROM ranked JOIN quotas ON ranked.{stratum} = quotas.s)"""


# Whitespace as it occurs in the data, for SQL.
SQL_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def sql_lengths(code: str = "code") -> str:
    return (
        f"length({code})::BIGINT AS n_chars, "
        f"(length({code}) - length(replace({code}, chr(10), '')) + 1)::BIGINT AS n_lines, "
        f"len(regexp_extract_all({code}, '[^ \\t\\n\\r\\f\\x0B]+'))::BIGINT AS n_whitespace_tokens"
    )


SQL_TOKENS = r"regexp_extract_all(code, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\n\r\f\x0BA-Za-z_0-9]')"
