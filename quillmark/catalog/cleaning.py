"""Registered queries: filters, duplicates, cleaning counters, normalization."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmark.catalog import base as B
from quillmark.functions import text as X
from quillmark.operators import clean as CL
from quillmark.operators import normalize as N
from quillmark.operators import profile as P

LANGUAGES = ("en", "fr")
MIN_LENGTH = 30
_LONG = f"length(trim(code, {B.SQL_BLANK})) >= {MIN_LENGTH}"


@B.register("clean_class_balance", f"""
WITH {B.SNIPS}, kept AS (SELECT * FROM snips WHERE language IN ('en', 'fr') AND {_LONG}),
first AS (SELECT min(row_id) AS row_id FROM kept GROUP BY code),
counts AS (SELECT CASE label WHEN 0 THEN 'human' ELSE 'ai' END AS label_name, count(*) AS n
           FROM kept JOIN first USING (row_id) GROUP BY ALL)
SELECT label_name, n, round(100.0 * n / sum(n) OVER (), 6)::DOUBLE AS pct FROM counts""")
def clean_class_balance(spark, sf_dir):
    cleaned = CL.clean(CL.filter_language(B.snippets(spark, sf_dir), LANGUAGES), MIN_LENGTH)
    balance = P.class_balance(P.with_label_name(cleaned), "label_name")
    return balance.select("label_name", "n", *B.r6("pct"))


@B.register("attach_label", f"WITH {B.SNIPS} SELECT row_id, label, language FROM snips")
def attach_label(spark, sf_dir):
    return B.snippets(spark, sf_dir).select("row_id", "label", "language")


@B.register("filter_language", f"WITH {B.DOCS} SELECT row_id, language FROM docs WHERE language IN ('en', 'fr')")
def filter_language(spark, sf_dir):
    return CL.filter_language(B.documents(spark, sf_dir), LANGUAGES).select("row_id", "language")


@B.register("filter_min_length", f"WITH {B.DOCS} SELECT row_id FROM docs WHERE {_LONG}")
def filter_min_length(spark, sf_dir):
    return CL.filter_min_length(B.documents(spark, sf_dir), MIN_LENGTH).select("row_id")


@B.register("reject_blank", f"""
WITH {B.DOCS}, lines AS (SELECT language, unnest(string_split(code, chr(10))) AS code FROM docs)
SELECT language, count(*) FILTER (length(trim(code, {B.SQL_BLANK})) > 0) AS n_accepted,
       count(*) FILTER (length(trim(code, {B.SQL_BLANK})) = 0) AS n_rejected FROM lines GROUP BY language""")
def reject_blank(spark, sf_dir):
    """Every line of every document as a snippet of its own."""
    lines = B.documents(spark, sf_dir).select("language", F.explode(F.split("code", "\n")).alias("code"))
    accepted, rejected = CL.reject_blank(lines)
    both = accepted.select("language", F.lit(1).alias("ok")).unionAll(rejected.select("language", F.lit(0).alias("ok")))
    return both.groupBy("language").agg(
        F.count_if(F.col("ok") == 1).alias("n_accepted"), F.count_if(F.col("ok") == 0).alias("n_rejected")
    )


@B.register("duplicate_count", f"""
WITH {B.DOCS} SELECT count(*) AS n_rows, count(DISTINCT code) AS n_distinct,
       count(*) - count(DISTINCT code) AS n_duplicates FROM docs""")
def duplicate_count(spark, sf_dir):
    return CL.duplicate_count(B.documents(spark, sf_dir))


@B.register("conflicting_labels", f"""
WITH {B.DOCS} SELECT count(*) AS n_conflicting FROM
(SELECT code FROM docs GROUP BY code HAVING count(DISTINCT source) > 1)""")
def conflicting_labels(spark, sf_dir):
    return CL.conflicting_labels(B.documents(spark, sf_dir), label="source")


@B.register("dedup_keep_first", f"""
WITH {B.DOCS} SELECT row_id, language, source, length(code)::BIGINT AS n_chars FROM docs
WHERE row_id IN (SELECT min(row_id) FROM docs GROUP BY code)""")
def dedup_keep_first(spark, sf_dir):
    kept = CL.dedup_keep_first(B.documents(spark, sf_dir))
    return kept.select("row_id", "language", "source", X.n_chars("code").alias("n_chars"))


@B.register("clean", f"""
WITH {B.DOCS}, kept AS (SELECT * FROM docs WHERE {_LONG})
SELECT row_id, language FROM kept WHERE row_id IN (SELECT min(row_id) FROM kept GROUP BY code)""")
def clean(spark, sf_dir):
    return CL.clean(B.documents(spark, sf_dir), MIN_LENGTH).select("row_id", "language")


@B.register("stage_retention", f"""
WITH {B.DOCS}, f AS (SELECT *, language IN ('en', 'fr') AS in_lang, {_LONG} AS is_long FROM docs),
kept AS (SELECT * FROM f WHERE in_lang AND is_long)
SELECT count(*) AS n_total, count(*) FILTER (in_lang) AS n_language,
  round(100.0 * count(*) FILTER (in_lang) / count(*), 6)::DOUBLE AS language_pct,
  count(*) FILTER (in_lang AND NOT is_long) AS dropped_short,
  (SELECT count(*) - count(DISTINCT code) FROM kept) AS dropped_duplicates,
  (SELECT count(DISTINCT code) FROM kept) AS n_clean,
  (SELECT count(*) FROM (SELECT code FROM kept GROUP BY code HAVING count(DISTINCT source) > 1)) AS n_conflicting
FROM f""")
def stage_retention(spark, sf_dir):
    out = CL.stage_retention(B.documents(spark, sf_dir), LANGUAGES, MIN_LENGTH, label="source")
    return out.withColumn("language_pct", F.round("language_pct", 6))


@B.register("encode_label", """
SELECT role, CASE lower(trim(role)) WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 END::INTEGER AS label,
       count(*) AS n FROM conversations GROUP BY ALL""")
def encode_label(spark, sf_dir):
    """Speaker roles as text labels; an unknown role is quarantined, not fatal."""
    turns = B.table(spark, sf_dir, "conversations")
    label = N.encode_label("role", turns.schema["role"].dataType, ("user",), ("assistant",), strict=False)
    return turns.select("role", label.alias("label")).groupBy("role", "label").agg(F.count("*").alias("n"))


@B.register("encode_label_numeric", """
SELECT l_orderkey, l_linenumber, CASE WHEN trunc(l_discount * 25) IN (0, 1) THEN trunc(l_discount * 25) END::INTEGER AS label
FROM lineitem""")
def encode_label_numeric(spark, sf_dir):
    """Fractions are cut toward zero; numbers other than 0 and 1 are no label."""
    lines = B.table(spark, sf_dir, "lineitem").withColumn("raw", F.col("l_discount") * 25)
    label = N.encode_label("raw", lines.schema["raw"].dataType, strict=False)
    return lines.select("l_orderkey", "l_linenumber", label.alias("label"))


@B.register("normalize_language", """
SELECT doc_id AS row_id, lower(lang) AS language FROM documents""")
def normalize_language(spark, sf_dir):
    raw = F.concat(F.lit(" \t"), F.upper("lang"), F.lit("\n "))
    return B.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), X.normalize_language(raw).alias("language")
    )


@B.register("paired_to_long", """
SELECT md5(text) AS code_md5, 0::INTEGER AS label, 'unknown' AS language, item_id FROM benchmark UNION ALL
SELECT md5(text || ' # end') AS code_md5, 1::INTEGER AS label, 'unknown' AS language, item_id FROM benchmark""")
def paired_to_long(spark, sf_dir):
    pairs = B.table(spark, sf_dir, "benchmark").select(
        "item_id", F.col("text").alias("Human_Code"), F.concat("text", F.lit(" # end")).alias("ai")
    )
    long = N.normalize_schema(pairs, keep=["item_id"])
    return long.select(F.md5("code").alias("code_md5"), "label", "language", "item_id")


@B.register("normalize_schema", f"""
WITH {B.SNIPS} SELECT row_id, md5(code) AS code_md5, label, language FROM snips""")
def normalize_schema(spark, sf_dir):
    """Unknown layout: the code column is ``Text``, the label ``IS_AI`` as text, the language ``Prog_Lang``."""
    raw = B.snippets(spark, sf_dir).select(
        "row_id", F.col("code").alias("Text"), "source", F.upper("language").alias("Prog_Lang"),
        F.when(F.col("label") == 1, " ChatGPT ").otherwise("Human-Written").alias("IS_AI"),
    )
    out = N.normalize_schema(raw, keep=["row_id"])
    return out.select("row_id", F.md5("code").alias("code_md5"), "label", "language")


@B.register("canonical_types", """
SELECT l_orderkey::VARCHAR AS code, CASE WHEN l_tax >= 0.04 THEN 1 ELSE 0 END::INTEGER AS label, 'unknown' AS language, count(*) AS n
FROM lineitem GROUP BY ALL""")
def canonical_types(spark, sf_dir):
    """A code column of numbers, a label column of booleans, no language: text, 0/1, ``unknown``."""
    raw = B.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("content"), (F.col("l_tax") >= 0.04).alias("Generated")
    )
    return N.normalize_schema(raw).groupBy("code", "label", "language").agg(F.count("*").alias("n"))
