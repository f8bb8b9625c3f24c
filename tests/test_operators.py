"""Operators on constructed tables: edge cases, golden numbers, properties."""

import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark import constants as C
from quillmark.functions import scoring as S
from quillmark.functions import text as X
from quillmark.operators import batches as BA
from quillmark.operators import clean as CL
from quillmark.operators import errors as E
from quillmark.operators import history as H
from quillmark.operators import metrics as M
from quillmark.operators import profile as P
from quillmark.operators import rank as R
from quillmark.operators import split as SP
from quillmark.operators import tokens as K


def rows(df, *cols):
    return [tuple(r) for r in (df.select(*cols) if cols else df).collect()]


# --- Texts ---------------------------------------------------------------------


def test_lengths(spark):
    texts = ["", "a", "a\n", "\n\n", "é😀", "a\tb  c", "x y z", "\x1ca\x1db"]
    df = P.length_features(spark.createDataFrame([(t,) for t in texts], "code string"))
    assert rows(df, "n_chars", "n_lines", "n_whitespace_tokens") == [
        (len(t), t.count("\n") + 1, len(t.split())) for t in texts
    ]


def test_strip_matches_every_kind_of_whitespace(spark):
    texts = [w + "a" + w + "b" + w for w in C.WHITESPACE] + [C.WHITESPACE, "", "​a"]
    df = spark.createDataFrame([(t,) for t in texts], "code string")
    assert [r[0] for r in rows(df.select(X.strip("code")))] == [t.strip() for t in texts]
    assert [r[0] for r in rows(df.select(X.n_whitespace_tokens("code")))] == [len(t.split()) for t in texts]


def test_tokens(spark):
    df = spark.createDataFrame([("def f_1(x):\n\treturn x+42 # ß",)], "code string")
    assert rows(df.select(X.tokens("code"))) == [
        (["def", "f_1", "(", "x", ")", ":", "return", "x", "+", "42", "#", "ß"],)
    ]


# --- Cleaning --------------------------------------------------------------------


CLEANING = [
    (0, None, 0), (1, "", 0), (2, "  ", 0), (3, "ab", 0), (4, " ab ", 1), (5, "abc", 0), (6, "abc", 1), (7, "abc ", 0),
    (8, "xyz", 1), (9, "xyz", 1), (10, " a ", 0), (11, "a b", 0),
]


def test_clean(spark):
    df = spark.createDataFrame(CLEANING, "row_id long, code string, label int").withColumn("language", F.lit("python"))
    assert sorted(r[0] for r in rows(CL.clean(df), "row_id")) == [5, 7, 8, 11]
    assert rows(CL.conflicting_labels(CL.filter_min_length(df))) == [(1,)]
    again = CL.clean(CL.clean(df))
    assert sorted(r[0] for r in rows(again, "row_id")) == [5, 7, 8, 11]
    # Not duplicates: texts that differ in outer blanks.
    kept = rows(CL.stage_retention(df))[0]
    assert kept == (12, 12, 100.0, 6, 2, 4, 1)


def test_stage_retention_of_nothing(spark):
    df = spark.createDataFrame([], "row_id long, code string, label int, language string")
    assert rows(CL.stage_retention(df)) == [(0, 0, 0.0, 0, 0, 0, 0)]


def test_filter_language_needs_its_column(spark):
    with pytest.raises(KeyError):
        CL.filter_language(spark.range(1))


@pytest.mark.parametrize("partitions", ["1", "8", "200"])
def test_dedup_with_a_third_of_copies(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(30_000).select(
            F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 1, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("code")
        )
        kept = CL.dedup_keep_first(df.repartition(16))
        assert kept.count() == 20_001
        assert rows(kept.where("code = 'copy'"), "row_id") == [(1,)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_dedup_limits_copies_before_the_shuffle(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("string").alias("code"))
    plan = CL.dedup_keep_first(df)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(_digest")
    assert "WindowGroupLimit" in plan[exchange:], "copies must be limited below the exchange"


# --- Profiles ----------------------------------------------------------------------


def test_histogram_integrates_to_one_per_class(spark):
    random.seed(1)
    data = [("human" if i % 3 else "ai", int(random.expovariate(0.01))) for i in range(3000)]
    counts = P.length_counts(spark.createDataFrame(data, "label_name string, n_chars long"), ["n_chars"])
    hist = P.length_histogram(counts)
    width = rows(counts.agg(F.min("value"), F.percentile("value", 0.99, F.col("n"))))[0]
    limit = max(v for _, v in data if v <= width[1])
    totals = rows(hist.groupBy("label_name").agg(F.sum(F.col("density") * (limit - width[0]) / 60)))
    assert all(math.isclose(t, 1.0, rel_tol=1e-9) for _, t in totals)
    assert hist.agg(F.max("bin")).first()[0] == 59


def test_histogram_of_one_value(spark):
    counts = spark.createDataFrame([("n_chars", "ai", 5, 7)], "metric string, label_name string, value long, n long")
    assert rows(P.length_histogram(counts), "bin", "bin_start", "n", "density") == [(30, 5.0, 7, 60.0)]


def test_describe_of_a_single_row_has_no_spread(spark):
    counts = spark.createDataFrame([("n_chars", "ai", 5, 1)], "metric string, label_name string, value long, n long")
    assert rows(P.length_describe(counts), "count", "mean", "std", "p50") == [(1, 5.0, None, 5.0)]


def test_later_split_wins(spark):
    splits = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "validation"), ("b", "train")], "code string, split string")
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "row_id long, code string")
    assert rows(P.tag_split(df, splits).orderBy("row_id"), "row_id", "split") == [
        (1, "test"), (2, "validation"), (3, "unknown"),
    ]


# --- Splits and samples --------------------------------------------------------------


def snippets(spark, humans, ais):
    n = humans + ais
    return spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") >= humans).cast("int").alias("label"))


def sizes(df):
    return {(r["split"], r["label"]): r["count"] for r in df.groupBy("split", "label").count().collect()}


def test_published_split_sizes(spark):
    got = sizes(SP.stratified_split(snippets(spark, 1207, 1471)))
    total = {s: got[s, 0] + got[s, 1] for s in C.SPLITS}
    assert total == {"train": 1874, "validation": 402, "test": 402}
    assert (got["test", 0], got["test", 1]) == (181, 221)
    assert (got["validation", 0], got["validation", 1]) == (181, 221)


def test_rounding_of_a_hundred_rows(spark):
    got = sizes(SP.stratified_split(snippets(spark, 50, 50)))
    assert [sum(n for (s, _), n in got.items() if s == x) for x in C.SPLITS] == [69, 16, 15]


def test_split_is_complete_stable_and_seeded(spark):
    df = snippets(spark, 300, 700)
    one = {r["row_id"]: r["split"] for r in SP.stratified_split(df).collect()}
    two = {r["row_id"]: r["split"] for r in SP.stratified_split(df.repartition(13)).collect()}
    other = {r["row_id"]: r["split"] for r in SP.stratified_split(df, seed=7).collect()}
    assert len(one) == 1000 and one == two and one != other


def test_split_does_not_shuffle_the_table(spark):
    df = snippets(spark, 300, 700).withColumn("code", F.lit("text"))
    plan = SP.stratified_split(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Project")
    physical = SP.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    first_join = physical.index("BroadcastHashJoin")
    assert "Exchange" not in physical[:first_join]


@pytest.mark.parametrize(
    "humans, ais, error",
    [(1, 1, "at least 3"), (1, 20, "at least 2"), (2, 2, "fewer rows"), (0, 0, "at least 3")],
)
def test_impossible_splits(spark, humans, ais, error):
    with pytest.raises(ValueError, match=error):
        SP.stratified_split(snippets(spark, humans, ais))


def test_bad_split_arguments(spark):
    df = snippets(spark, 10, 10)
    with pytest.raises(ValueError, match="positive"):
        SP.stratified_split(df, ratios=(1.0, 0.0, 0.0))
    with pytest.raises(ValueError, match="add up"):
        SP.stratified_split(df, ratios=(0.7, 0.2, 0.2))
    with pytest.raises(KeyError):
        SP.stratified_split(df, stratum="absent")


def test_subsample(spark):
    df = spark.range(20_000).withColumnRenamed("id", "row_id")
    small = {r[0] for r in rows(SP.subsample(df, 50))}
    large = {r[0] for r in rows(SP.subsample(df, 15_000))}
    assert len(small) == 50 and len(large) == 15_000 and small < large
    assert SP.subsample(df, 30_000).count() == SP.subsample(df, None).count() == SP.subsample(df, -1).count() == 20_000


def test_epochs_are_permutations(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    one = dict(rows(SP.shuffle_epoch(df, 1)))
    two = dict(rows(SP.shuffle_epoch(df, 2)))
    assert sorted(one.values()) == sorted(two.values()) == list(range(500)) and one != two


def test_batches(spark):
    schema = "row_id long, label int, input_ids array<int>, attention_mask array<tinyint>"
    data = [(i, i % 2, [0] + [9] * (i % 5) + [2], [1] * (2 + i % 5)) for i in range(70)]
    out = BA.assemble_batches(spark.createDataFrame(data, schema), batch_size=32).collect()
    by_batch = {}
    for r in out:
        by_batch.setdefault(r["batch_id"], []).append(r)
    assert {b: len(x) for b, x in by_batch.items()} == {0: 32, 1: 32, 2: 6}
    for batch in by_batch.values():
        width = max(2 + r["row_id"] % 5 for r in batch)
        for r in batch:
            n = 2 + r["row_id"] % 5
            assert len(r["input_ids"]) == len(r["attention_mask"]) == width
            assert r["attention_mask"] == [1] * n + [0] * (width - n)
            assert r["input_ids"][n:] == [C.PAD_ID] * (width - n)


# --- Ranks ------------------------------------------------------------------------------


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles_are_exact_with_one_hot_value(spark, by):
    random.seed(3)
    data = [(i % 2 if i % 7 else None, 0.5 if i % 3 == 0 else random.random()) for i in range(4000)]
    df = spark.createDataFrame(data, "g int, v double").repartition(9)
    probs = [0.0, 0.25, 0.5, 0.999, 1.0]
    got = {tuple(r[:-1]): r[-1] for r in R.exact_quantiles(df, "v", probs, by, buckets=16).collect()}
    expected = df.groupBy(*by).agg(F.percentile("v", probs).alias("q"))
    for r in expected.collect():
        for p, q in zip(probs, r["q"]):
            assert math.isclose(got[(*r[:-1], p)], q, abs_tol=1e-12)


def test_prefix_sums_equal_a_single_window(spark):
    random.seed(5)
    data = [(i, random.choice([0.1, 0.1, random.random()]), random.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(data, "id long, v double, w long")
    hist = df.groupBy("v").agg(F.sum("w").alias("w"))
    got = dict(rows(R.prefix_sums(R.with_bucket(hist, "v", R.split_points(df, "v", 32)), ["v"], {"before": "w"}), "v", "before"))
    running, expected = 0, {}
    for v, w in sorted(rows(hist)):
        expected[v] = running
        running += w
    assert got == expected


# --- Measures -----------------------------------------------------------------------------


def golden(spark):
    """181 human and 221 ai rows; two human rows reach .5, one of them above exactly one ai row."""
    humans = [0.001 * i for i in range(179)] + [0.6, 0.9]
    ais = [0.95 + 0.0002 * i for i in range(219)] + [0.94, 0.85]
    data = [(i, 0, p) for i, p in enumerate(humans)] + [(1000 + i, 1, p) for i, p in enumerate(ais)]
    return spark.createDataFrame(data, "row_id long, label int, prob_ai double")


def test_golden_bundle(spark):
    b = M.metric_bundle(golden(spark)).first()
    assert (b["tn"], b["fp"], b["fn"], b["tp"]) == (179, 2, 0, 221)
    expected = {
        "accuracy": 0.9950248756, "macro_f1": 0.9949699700, "auc_roc": 0.9999750006, "precision_human": 1.0,
        "recall_human": 0.9889502762, "precision_ai": 0.9910313901, "recall_ai": 1.0,
    }
    for name, value in expected.items():
        assert math.isclose(b[name], value, abs_tol=5e-11), name
    assert (b["support_human"], b["support_ai"], b["n_samples"]) == (181, 221, 402)


def test_auc_of_the_complement(spark):
    df = golden(spark)
    auc = M.auc_roc(df).first()[0]
    assert math.isclose(M.auc_roc(df.withColumn("prob_ai", 1 - F.col("prob_ai"))).first()[0], 1 - auc, abs_tol=1e-12)


def test_auc_with_ties_and_hot_score(spark):
    random.seed(11)
    data = [(i, random.randint(0, 1), 0.5 if i % 3 == 0 else round(random.random(), 2)) for i in range(600)]
    df = spark.createDataFrame(data, "row_id long, label int, prob_ai double")
    pos = [p for _, y, p in data if y]
    neg = [p for _, y, p in data if not y]
    pairs = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert math.isclose(M.auc_roc(df).first()[0], pairs, abs_tol=1e-12)


def test_roc_without_collinear_points(spark):
    data = [(i, y, p) for i, (y, p) in enumerate([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.6), (0, 0.5), (1, 0.4)])]
    df = spark.createDataFrame(data, "row_id long, label int, prob_ai double")
    points = rows(M.roc_curve(df, drop_collinear=True).orderBy(F.desc("threshold")), "fpr", "tpr")
    assert points == [(0.0, 0.0), (0.0, 0.25), (0.0, 0.75), (1.0, 0.75), (1.0, 1.0)]
    assert M.roc_curve(df).count() == 7


def test_ids_from_a_vocabulary_of_millions(spark):
    n = 5_000_000
    vocab = spark.range(n).select(F.concat(F.lit("t"), "id").alias("token"), (F.col("id") + C.FIRST_TOKEN_ID).cast("int").alias("token_id"))
    data = [(i, [f"t{i}", "t0", f"t{n - 1 - i}", "nowhere", f"t{4_000_000}", f"t{i}"] if i % 5 else []) for i in range(200)]
    df = spark.createDataFrame(data, "row_id long, tokens array<string>")
    got = {r["row_id"]: r["input_ids"] for r in K.encode_ids(df, vocab, in_place=1000).collect()}
    shift = C.FIRST_TOKEN_ID
    for i, tokens in data:
        body = [i + shift, shift, n - 1 - i + shift, C.UNKNOWN_ID, 4_000_000 + shift, i + shift] if tokens else []
        assert got[i] == [C.BEGIN_ID, *body, C.END_ID]
    with pytest.raises(KeyError, match="unique"):
        K.encode_ids(df.drop("row_id"), vocab, in_place=1000)


def test_ids_are_the_same_either_way(spark):
    rng = random.Random(2)
    data = [(i, [f"w{min(int(rng.expovariate(0.05)), 300)}" for _ in range(rng.randint(0, 40))]) for i in range(400)]
    df = spark.createDataFrame(data, "row_id long, tokens array<string>")
    vocab = spark.createDataFrame([(f"w{i}", i + C.FIRST_TOKEN_ID) for i in range(0, 250)], "token string, token_id int")
    one = {r["row_id"]: (r["input_ids"], r["attention_mask"]) for r in K.encode_ids(df, vocab).collect()}
    two = {r["row_id"]: (r["input_ids"], r["attention_mask"]) for r in K.encode_ids(df, vocab, in_place=10).collect()}
    assert one == two


def test_scores_merge_and_sum_up(spark):
    rng = random.Random(4)
    data = [(i, rng.randint(0, 1), rng.randint(0, 40) / 40, ["a", "b", None][rng.randint(0, 2)]) for i in range(900)]
    df = spark.createDataFrame(data, "row_id long, label int, prob_ai double, part string")
    whole = M.metric_bundle(df).first()
    merged = M.merge_scores([M.score_table(df.where("row_id % 3 = 0")), M.score_table(df.where("row_id % 3 > 0"))])
    assert M.metric_bundle(merged).first() == whole
    assert sorted(rows(M.roc_curve(merged), "threshold", "fpr", "tpr")) == sorted(rows(M.roc_curve(df), "threshold", "fpr", "tpr"))
    both = M.score_table(df, by=["part"], overall="all")
    bundles = {r["part"]: r for r in M.metric_bundle(both).collect()}
    assert set(bundles) == {"a", "b", None, "all"}
    assert tuple(bundles["all"])[1:] == tuple(whole)
    assert tuple(bundles["a"])[1:] == tuple(M.metric_bundle(df.where("part = 'a'")).first())
    assert M.confusion_matrix(both).count() == 16
    with pytest.raises(ValueError, match="same groups"):
        M.merge_scores([both, merged])
    with pytest.raises(ValueError, match="grouped by"):
        M.metric_bundle(merged, by=["part"])


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.5,), (0.49999,)], "p double")
    assert rows(df.select(S.hard_prediction("p"))) == [(1,), (0,)]


def test_normalized_matrix_with_absent_class(spark):
    df = spark.createDataFrame([(0, 0, 0.1), (1, 0, 0.7)], "row_id long, label int, prob_ai double")
    got = {(r["label"], r["prediction"]): r["share"] for r in M.confusion_matrix(df).collect()}
    assert got == {(0, 0): 0.5, (0, 1): 0.5, (1, 0): 0.0, (1, 1): 0.0}
    assert M.auc_roc(df).first()[0] is None
    prf = {r["label_name"]: r["f1"] for r in M.per_class_prf(df).collect()}
    assert prf["ai"] == 0.0


@pytest.mark.parametrize(
    "data, error",
    [([], "no predictions"), ([(0, 0.1), (0, 0.2)], "one class"), ([(0, 0.1), (1, None)], "lack"), ([(0, 0.1), (2, 0.3)], "neither")],
)
def test_invalid_predictions(spark, data, error):
    with pytest.raises(ValueError, match=error):
        M.validate_predictions(spark.createDataFrame(data, "label int, prob_ai double"))


def test_losses_agree(spark):
    df = spark.createDataFrame([(0, -3.0), (1, 2.0), (1, -40.0), (0, 0.0)], "label int, logit double")
    df = df.withColumn("prob_ai", S.sigmoid("logit"))
    a = M.mean_bce_loss(df, logit="logit").first()["loss"]
    b = M.mean_bce_loss(df.where("logit > -30")).first()["loss"]
    c = M.mean_bce_loss(df.where("logit > -30"), logit="logit").first()["loss"]
    assert math.isclose(b, c, abs_tol=1e-12) and math.isclose(a, (3 * c + 40) / 4, abs_tol=1e-9)


def test_class_names(spark):
    nested = M.nested_bundle(M.metric_bundle(golden(spark)), names=("person", "model")).first()
    assert nested["support"] == {"person": 181, "model": 221} and nested["per_class"]["person"]["precision"] == 1.0
    assert nested["confusion_matrix"] == [[179, 2], [0, 221]]
    assert {r[0] for r in rows(M.per_class_prf(golden(spark), names=("person", "model")), "label_name")} == {"person", "model"}
    with pytest.raises(ValueError, match="two class names"):
        M.per_class_prf(golden(spark), names=("one",))


def test_report_shows_missing_values(spark):
    flat = M.metric_bundle(golden(spark)).withColumn("auc_roc", F.lit(None).cast("double"))
    shown = dict(rows(M.metrics_to_long(flat), "metric", "shown"))
    assert shown["AUC-ROC"] == "TBD" and shown["Accuracy"] == "0.9950" and len(shown) == 9


# --- Errors ---------------------------------------------------------------------------------


def test_golden_error_summary(spark):
    data = [
        (0, "x" * (2527 - 104) + "\n" * 104, 0, 1, 0.9995267391204834),
        (1, "x" * (926 - 41) + "\n" * 41, 0, 1, 0.9987461566925049),
        (2, "abc", 1, 1, 0.9),
    ]
    df = E.error_table(spark.createDataFrame(data, "row_id long, code string, label int, prediction int, prob_ai double"))
    s = E.error_summary(df).first()
    assert (s["n_test"], s["n_errors"], s["errors_true_human"], s["errors_predicted_ai"]) == (3, 2, 2, 2)
    assert math.isclose(s["mean_confidence_on_errors"], 0.9991364479, abs_tol=5e-11)
    assert math.isclose(s["median_confidence_on_errors"], 0.9991364479, abs_tol=5e-11)
    assert (s["errors_n_chars_mean"], s["errors_n_lines_mean"], s["correct_n_chars_mean"]) == (1726.5, 73.5, 3.0)
    assert [r[0] for r in rows(E.top_errors(df, 5), "row_id")] == [0, 1]


def test_summary_without_errors(spark):
    df = E.error_table(spark.createDataFrame([(0, "a", 1, 1, 0.9)], "row_id long, code string, label int, prediction int, prob_ai double"))
    s = E.error_summary(df).first()
    assert s["error_rate"] == 0.0 and s["mean_confidence_on_errors"] is None
    assert s["median_confidence_on_errors"] is None and s["errors_n_chars_mean"] is None


def test_alignment_is_checked(spark):
    preds = spark.createDataFrame([(1, 0.5), (2, 0.6)], "row_id long, prob_ai double")
    texts = spark.createDataFrame([(1, "a"), (3, "b")], "row_id long, code string")
    with pytest.raises(ValueError, match="2 row ids"):
        E.align_predictions(preds, texts)
    twice = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "row_id long, code string")
    with pytest.raises(ValueError, match="1 row ids"):
        E.align_predictions(preds, twice)


# --- Tokens ------------------------------------------------------------------------------------


def test_encode(spark):
    df = spark.createDataFrame([(0, "b a b", 1), (1, "c ? ?? b", 0), (2, "", 1)], "row_id long, code string, label int")
    vocab = K.build_vocab(df, 2)
    assert rows(vocab.orderBy("token_id")) == [("?", 3, 4), ("b", 3, 5)]
    out = K.keep_token_columns(K.encode_ids(K.tokenize(df, 5), vocab)).orderBy("row_id")
    assert rows(out, "input_ids", "attention_mask") == [
        ([0, 5, 3, 5, 2], [1] * 5), ([0, 3, 4, 4, 2], [1] * 5), ([0, 2], [1, 1]),
    ]


def test_encode_does_not_shuffle_rows(spark):
    df = spark.createDataFrame([(0, "a", 1)], "row_id long, code string, label int")
    vocab = spark.createDataFrame([("a", 1, 4)], "token string, n long, token_id int")
    plan = K.encode_ids(K.tokenize(df), vocab)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Subquery")[0]


def test_missing_token_column(spark):
    with pytest.raises(ValueError, match="attention_mask"):
        K.keep_token_columns(spark.createDataFrame([(1, [1], 0)], "row_id long, input_ids array<int>, label int"))


def test_truncation_counts_at_the_given_limit(spark):
    df = spark.createDataFrame([("test", 128), ("test", 5)], "split string, n_tokens int")
    assert rows(K.token_length_summary(df, 128), "truncated_pct") == [(50.0,)]


# --- Histories ------------------------------------------------------------------------------------


def test_early_stop(spark):
    losses = [0.0391, 0.0214, 0.0130, 0.02, 0.0130000001, 0.001]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(losses)] + [("s", 1, 0.5)], "run_id string, epoch int, val_loss double")
    got = {r["run_id"]: tuple(r)[1:] for r in H.early_stop(df).collect()}
    assert got == {"r": (3, 0.0130, 5, True), "s": (1, 0.5, 1, False)}


# --- Partitioning ---------------------------------------------------------------------------------


def test_results_do_not_depend_on_shuffle_partitions(spark):
    random.seed(17)
    data = [(i, random.randint(0, 1), 1.0 if i % 3 == 0 else random.random()) for i in range(3000)]
    df = spark.createDataFrame(data, "row_id long, label int, prob_ai double").repartition(11)
    seen = set()
    for n in ("1", "8", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        split = tuple(sorted(rows(SP.stratified_split(df), "row_id", "split")))
        auc = round(M.auc_roc(df).first()[0], 12)
        roc = tuple(sorted((round(a, 12), round(b, 12)) for a, b in rows(M.roc_curve(df, drop_collinear=True), "fpr", "tpr")))
        sample = tuple(sorted(rows(SP.subsample(df, 100), "row_id")))
        order = tuple(sorted(rows(SP.shuffle_epoch(df.select("row_id"), 1))))
        seen.add((split, auc, roc, sample, order))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(seen) == 1


def test_top_rows_with_many_ties(spark):
    df = E.error_table(
        spark.range(5000).select(
            F.col("id").alias("row_id"), F.lit("x").alias("code"), F.lit(0).alias("label"), F.lit(1).alias("prediction"),
            F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 5000).alias("prob_ai"),
        )
    )
    assert [r[0] for r in E.top_errors(df, 4).select("row_id").collect()] == [0, 3, 6, 9]
    big = E.top_errors(df, 3000).select("row_id", "confidence").collect()
    assert len(big) == 3000 and big[1666][1] == 1.0 and big[1667][0] == 4999
