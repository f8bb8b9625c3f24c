"""Registered queries: balance, lengths, split tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark import constants as C
from quillmark.catalog import base as B
from quillmark.functions import text as X
from quillmark.operators import profile as P
from quillmark.operators import split as SP

_NAME = "CASE label WHEN 0 THEN 'human' WHEN 1 THEN 'ai' END"
_LONG_COUNTS = f"""
lens AS (SELECT {_NAME} AS label_name, {B.sql_lengths()} FROM snips),
long AS (SELECT label_name, 'n_chars' AS metric, n_chars AS value FROM lens UNION ALL
         SELECT label_name, 'n_lines', n_lines FROM lens UNION ALL
         SELECT label_name, 'n_whitespace_tokens', n_whitespace_tokens FROM lens)"""


def _counts(spark, sf_dir):
    return P.length_counts(P.length_features(P.with_label_name(B.snippets(spark, sf_dir, heavy=True))))


@B.register("length_features", f"WITH {B.DOCS} SELECT row_id, {B.sql_lengths()} FROM docs")
def length_features(spark, sf_dir):
    return P.length_features(B.documents(spark, sf_dir, heavy=True)).select("row_id", *C.LENGTH_METRICS)


@B.register("label_name", f"WITH {B.SNIPS} SELECT row_id, label, {_NAME} AS label_name FROM snips")
def label_name(spark, sf_dir):
    return P.with_label_name(B.snippets(spark, sf_dir)).select("row_id", "label", "label_name")


@B.register("class_balance", f"""
WITH {B.SNIPS}, c AS (SELECT language, label, count(*) AS n FROM snips GROUP BY ALL)
SELECT language, label, n, round(100.0 * n / sum(n) OVER (PARTITION BY language), 6)::DOUBLE AS pct FROM c""")
def class_balance(spark, sf_dir):
    out = P.class_balance(B.snippets(spark, sf_dir), by=["language"])
    return out.select("language", "label", "n", *B.r6("pct"))


@B.register("class_balance_named", f"""
WITH {B.SNIPS}, c AS (SELECT {_NAME} AS label_name, count(*) AS n FROM snips GROUP BY ALL)
SELECT label_name, n, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS pct FROM c""")
def class_balance_named(spark, sf_dir):
    out = P.class_balance(P.with_label_name(B.snippets(spark, sf_dir)), "label_name")
    return out.select("label_name", "n", *B.r6("pct"))


@B.register("balance_by_split", f"""
WITH {B.SNIPS}, {B.sql_split('snips', 'label')}
SELECT split, count(*) FILTER (label = 1) AS ai, count(*) FILTER (label = 0) AS human, count(*) AS total
FROM parted GROUP BY split""")
def balance_by_split(spark, sf_dir):
    return P.balance_by_split(P.with_label_name(SP.stratified_split(B.snippets(spark, sf_dir))))


@B.register("distinct_languages", f"WITH {B.DOCS} SELECT DISTINCT language FROM docs ORDER BY language")
def distinct_languages(spark, sf_dir):
    return P.distinct_languages(B.documents(spark, sf_dir))


@B.register("length_describe", f"""
WITH {B.SNIPS}, {_LONG_COUNTS}
SELECT metric, label_name, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
       min(value) AS min, round(quantile_cont(value, 0.5), 6)::DOUBLE AS p50, round(quantile_cont(value, 0.9), 6)::DOUBLE AS p90,
       round(quantile_cont(value, 0.95), 6)::DOUBLE AS p95, round(quantile_cont(value, 0.99), 6)::DOUBLE AS p99,
       max(value) AS max FROM long GROUP BY metric, label_name""")
def length_describe(spark, sf_dir):
    out = P.length_describe(_counts(spark, sf_dir))
    return out.select(
        "metric", "label_name", "count", *B.r6("mean", "std"), "min", *B.r6("p50", "p90", "p95", "p99"), "max"
    )


@B.register("length_describe_offset", f"""
WITH {B.SNIPS}, {_LONG_COUNTS}
SELECT metric, label_name, round(avg(value + 1000000000), 3) AS mean, round(stddev_samp((value + 1000000000)::DOUBLE), 4) AS std
FROM long GROUP BY metric, label_name""")
def length_describe_offset(spark, sf_dir):
    """The spread doesn't drown in a large common offset."""
    counts = _counts(spark, sf_dir)
    out = P.length_describe(counts.withColumn("value", F.col("value") + 1_000_000_000))
    return out.select("metric", "label_name", F.round("mean", 3).alias("mean"), F.round("std", 4).alias("std"))


@B.register("p99", f"""
WITH {B.SNIPS}, {_LONG_COUNTS}
SELECT metric, round(quantile_cont(value, 0.99), 6)::DOUBLE AS p99 FROM long GROUP BY metric""")
def p99(spark, sf_dir):
    return P.length_quantile(_counts(spark, sf_dir)).select("metric", *B.r6("p99"))


@B.register("clip_p99", f"""
WITH {B.DOCS}, f AS (SELECT row_id, {B.sql_lengths()} FROM docs)
SELECT row_id, n_chars FROM f WHERE n_chars <= (SELECT quantile_cont(n_chars, 0.99) FROM f)""")
def clip_p99(spark, sf_dir):
    rows = B.documents(spark, sf_dir).select("row_id", X.n_chars("code").alias("n_chars"))
    return P.clip_p99(rows, "n_chars")


@B.register("length_histogram", f"""
WITH {B.SNIPS}, {_LONG_COUNTS},
lim AS (SELECT metric, quantile_cont(value, 0.99) AS p FROM long GROUP BY metric),
kept AS (SELECT long.* FROM long JOIN lim USING (metric) WHERE value <= p),
span AS (SELECT metric, min(value) AS lo, (max(value) - min(value))::DOUBLE / 60 AS w FROM kept GROUP BY metric),
binned AS (SELECT metric, label_name, least(floor((value - lo) / w), 59)::INTEGER AS bin, lo, w, count(*) AS n
           FROM kept JOIN span USING (metric) GROUP BY ALL)
SELECT metric, label_name, bin, round(lo + bin * w, 6)::DOUBLE AS bin_start, n,
       round(n / (sum(n) OVER (PARTITION BY metric, label_name) * w), 6)::DOUBLE AS density FROM binned""")
def length_histogram(spark, sf_dir):
    out = P.length_histogram(_counts(spark, sf_dir))
    return out.select("metric", "label_name", "bin", F.round("bin_start", 6).alias("bin_start"), "n", *B.r6("density"))


@B.register("bars_per_class", f"""
WITH {B.SNIPS} SELECT {_NAME} AS label_name, count(*) AS n FROM snips GROUP BY ALL""")
def bars_per_class(spark, sf_dir):
    return P.class_balance(P.with_label_name(B.snippets(spark, sf_dir)), "label_name").select("label_name", "n")


@B.register("tag_split", f"""
WITH {B.DOCS}, {B.SNIPS}, {B.sql_split('snips', 'label')},
tags AS (SELECT code, max(CASE split WHEN 'train' THEN 1 WHEN 'validation' THEN 2 ELSE 3 END) AS t FROM parted GROUP BY code)
SELECT row_id, CASE t WHEN 1 THEN 'train' WHEN 2 THEN 'validation' WHEN 3 THEN 'test' ELSE 'unknown' END AS split
FROM docs LEFT JOIN tags USING (code)""")
def tag_split(spark, sf_dir):
    """All documents tagged by the split their text fell into, if it was labelled."""
    splits = SP.stratified_split(B.snippets(spark, sf_dir)).select("code", "split")
    return P.tag_split(B.documents(spark, sf_dir), splits).select("row_id", "split")


@B.register("sorted_output", f"""
WITH {B.DOCS} SELECT language, source, count(*) AS n FROM docs GROUP BY ALL ORDER BY n DESC, language, source""")
def sorted_output(spark, sf_dir):
    """A sorted report over counted rows."""
    counts = B.documents(spark, sf_dir).groupBy("language", "source").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "language", "source")
