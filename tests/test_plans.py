"""Plans keep what they promise: few scans, narrow shuffles, pushdown, split hot keys."""

import re

import pytest
from pyspark.sql import functions as F

from quillmark.catalog import base as B
from quillmark.operators import clean as CL
from quillmark.operators import errors as E
from quillmark.operators import metrics as M
from quillmark.operators import profile as P
from quillmark.operators import split as SP
from quillmark.operators import tokens as K
from quillmark.session import stored
from quillmark.sources import artifacts as A


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def executed(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return planned(df).split("Initial Plan")[0]


@pytest.fixture(scope="module")
def preds(spark, sf_dir):
    return stored(B.predictions(spark, sf_dir), "preds")


def counted(spark, df, column="prob_ai"):
    """The table, and a counter of how many of its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def look(value):
        seen.add(1)
        return value

    return df.withColumn(column, F.udf(look, "double").asNondeterministic()(column)), seen


def test_predictions_are_read_once_for_all_measures(spark, preds):
    df, seen = counted(spark, preds.select("row_id", "label", "prob_ai"))
    n = preds.count()
    scores = M.score_table(df)
    M.validate_predictions(scores)
    reports = [M.metric_bundle(scores), M.roc_curve(scores), M.roc_curve(scores, drop_collinear=True), M.confusion_matrix(scores), M.auc_roc(scores)]
    assert all(r.count() for r in reports) and seen.value == n
    for report in (M.metric_bundle, M.roc_curve, lambda x: M.roc_curve(x, drop_collinear=True), M.auc_roc):
        df, seen = counted(spark, preds.select("row_id", "label", "prob_ai"))
        assert report(df).count() and seen.value == n


def test_errors_join_once(spark, preds):
    scored, seen = counted(spark, preds.select("row_id", "label", "prob_ai", "prediction"))
    table = E.error_rows(scored, preds.select("row_id", "code"))
    assert table.top(5).count() == 5 and table.top(None).count() == table.summary().first()["n_errors"]
    assert seen.value == preds.count()
    shown = planned(table.summary())
    assert "code" not in shown
    texts = planned(table.top(5))
    assert "Exchange hashpartitioning" not in texts, "texts stay where they are"


def test_texts_without_copies_are_not_shuffled(spark):
    df = stored(
        spark.range(20_000).select(
            F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.concat(F.lit("text "), "id")).alias("code")
        ),
        "texts",
    )
    marked = CL._marked(df, "code")
    plan = planned(marked.where("NOT _maybe"))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    counts = {r["_maybe"]: r["n"] for r in marked.groupBy("_maybe", (F.col("code") == "copy").alias("c")).agg(F.count("*").alias("n")).where("c").collect()}
    assert counts == {True: 6_667} and marked.where("_maybe AND code <> 'copy'").count() < 10
    assert CL.dedup_keep_first(df).count() == 13_334


def test_vocabulary_counts_tokens_once(spark, sf_dir):
    rows = stored(B.documents(spark, sf_dir), "docs")
    plan = executed(K.build_vocab(rows, 100))
    assert plan.count("FileScan") <= 2 and "ReusedExchange" in plan


def test_length_reports_scan_texts_once(preds):
    counts = P.length_counts(P.length_features(P.with_label_name(preds)))
    for report in (P.length_describe(counts), P.length_histogram(counts), P.length_quantile(counts)):
        plan = planned(report)
        assert plan.count("FileScan") == 1
        # Texts end where the lengths begin, below the first shuffle.
        above = plan[: plan.index("Expand")]
        assert "code" not in above


def test_filter_reaches_the_scan(spark, sf_dir):
    plan = planned(CL.filter_language(B.documents(spark, sf_dir), ("en", "fr")).select("row_id"))
    assert re.search(r"PushedFilters: \[In\(lang, \[en,fr\]\)\]", plan)
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_split_scan_reads_one_folder_and_its_columns(spark, preds):
    path = stored(SP.stratified_split(preds), "x")
    from quillmark.session import scratch_path

    folder = scratch_path(spark, "splits")
    A.write_splits(path, folder)
    plan = planned(A.scan_split(spark, folder, "test").select("row_id"))
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<row_id:bigint>" in plan
    assert "ReadSchema: struct<code:string>" in planned(A.scan_code_only(spark, folder))


def test_top_errors_ranks_ids_only(preds):
    plan = planned(E.top_errors(E.error_table(preds), 5))
    ids = plan[plan.index("BroadcastExchange"):]
    assert "code" not in re.findall(r"FileScan parquet \[([^\]]*)\]", ids)[0]


def test_hot_text_is_split_when_tagging(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "64",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        df = spark.range(0, 60_000, 1, 12).select(
            F.col("id").alias("row_id"),
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("text number "), "id")).alias("code"),
            F.sha2(F.col("id").cast("string"), 512).alias("payload"),
        )
        splits = df.where("row_id % 2 = 0").select("code", F.lit("train").alias("split"))
        tagged = P.tag_split(df, splits)
        plan = executed(tagged)
        assert "skew=true" in plan
        assert tagged.where("split = 'train'").count() == 40_000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_no_row_wise_python(spark, sf_dir):
    from quillmark import catalog

    for name in ("clean", "length_describe", "tokenize", "encode_ids", "error_summary", "roc_curve", "stratified_split", "early_stop"):
        plan = planned(catalog.QUERIES[name](spark, sf_dir))
        assert "Python" not in plan and "InPandas" not in plan, name
