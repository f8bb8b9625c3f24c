"""The flow from raw files to reports, on files made here."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import clean as CL
from quillmark.operators import history as H
from quillmark.operators import model as MO
from quillmark.plans import phases as PH
from quillmark.sources import artifacts as A
from quillmark.streaming import classify as ST

N = 240


def snippet(i):
    """Human snippets loop, the others map; short ones, copies and other languages among them."""
    rng = random.Random(i)
    name = f"v{rng.randint(0, 10_000)}"
    return f"for {name} in xs:\n    print({name}, {i})" if i % 2 else f"list(map(lambda {name}: {name} + {i}, xs))"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("flow")
    rows = [(snippet(i), "human" if i % 2 else "AI", "Python" if i % 4 < 3 else "Java") for i in range(N)]
    rows += [(snippet(0), "human", "py"), ("x", "ai", "python"), (None, "ai", "python")]
    df = spark.createDataFrame(rows, "Sample string, target string, lang string")
    df.where("lang = 'Java'").write.json(str(root / "raw" / "java"))
    df.where("lang <> 'Java'").repartition(3).write.option("header", True).option("escape", '"').csv(str(root / "raw" / "python"))
    PH.prepare(spark, str(root / "raw"), str(root / "interim"), str(root / "splits"))
    PH.train(spark, str(root / "splits"), str(root / "run"), MO.RunConfig(num_features=1 << 12, extra={"note": "n"}),
             [MO.Candidate(0.1, 10), MO.Candidate(0.01, 10)], run_id="first")
    return root


def test_prepare(spark, folders):
    out = PH.prepare(spark, str(folders / "raw"), str(folders / "interim2"), str(folders / "splits2"))
    assert {tuple(r) for r in out.languages.collect()} == {("java",), ("py",), ("python",)}
    kept = out.retention.first()
    assert (kept["n_total"], kept["n_language"], kept["dropped_short"], kept["dropped_duplicates"], kept["n_conflicting"]) == (
        N + 3, 183, 2, 1, 1,
    )
    assert sum(r["n"] for r in out.split_balance.collect()) == 180 == A.scan_interim(spark, str(folders / "interim2")).count()


def test_analyze(spark, folders):
    out = PH.analyze(spark, str(folders / "interim"), str(folders / "splits"))
    assert {r["split"] for r in out.balance_by_split.collect()} == {"train", "validation", "test"}
    assert out.duplicates.first()["n_duplicates"] == 0
    assert out.length_describe.count() == 6 and out.length_p99.count() == 3
    assert out.length_histogram.count() > 0 and out.balance.count() == 2


def test_tokenize(spark, folders):
    summary = PH.tokenize(spark, str(folders / "splits"), str(folders / "tok"), str(folders / "vocab"), max_length=12, vocab_size=30)
    got = {r["split"]: r for r in summary.collect()}
    assert set(got) == {"train", "validation", "test"} and all(r["max"] == 12 for r in got.values())
    with pytest.raises(ValueError, match="extra"):
        A.scan_tokenized(spark, str(folders / "tok"), ["train", "extra"])


def test_run_is_stored(spark, folders):
    run = str(folders / "run")
    _, config = A.load_model(spark, run)
    assert config["num_features"] == 4096 and config["extra"] == {"note": "n"}
    history = A.scan_history(spark, run)
    curves = H.training_curves(history).collect()
    assert [r["epoch"] for r in curves] == [1, 2] and curves[1]["train_loss"] < curves[0]["train_loss"]
    best = H.early_stop(history).first()
    assert best["best_epoch"] == min(curves, key=lambda r: r["val_loss"])["epoch"]
    assert A.scan_history(spark, str(folders / "absent")).count() == 0
    with pytest.raises(FileNotFoundError):
        A.load_model(spark, str(folders / "absent"))


def test_evaluate_and_errors(spark, folders):
    splits, predictions = str(folders / "splits"), str(folders / "predictions")
    out = PH.evaluate(spark, splits, str(folders / "run"), predictions, str(folders / "reports" / "first_test"))
    bundle = out.bundle.first()
    assert bundle["n_samples"] == 27 and bundle["accuracy"] > 0.9
    assert out.confusion.agg(F.sum("n")).first()[0] == 27 and out.per_class.count() == 2 and out.roc.count() >= 2
    top, summary = PH.analyze_errors(
        spark, predictions, splits, csv_path=str(folders / "errors"), summary_path=str(folders / "reports" / "first_errors")
    )
    s = summary.first()
    assert s["n_errors"] == 27 - bundle["tn"] - bundle["tp"] == top.count()
    strict = PH.evaluate(spark, splits, str(folders / "run"), str(folders / "strict"), threshold=1.1).bundle.first()
    assert (strict["tp"], strict["fp"], strict["threshold"]) == (0, 0, 1.1)
    runs = PH.compare_runs(spark, str(folders / "reports")).collect()
    assert [r["name"] for r in runs] == ["first_test"] and abs(runs[0]["Accuracy"] - bundle["accuracy"]) < 1e-12
    kinds = {r["name"]: r["kind"] for r in A.scan_metric_files(spark, str(folders / "reports")).collect()}
    assert kinds == {"first_test": "metrics", "first_errors": "error_summary"}


def test_all_splits_at_once(spark, folders):
    splits, run = str(folders / "splits"), str(folders / "run")
    out = PH.evaluate_splits(spark, splits, run, str(folders / "all-predictions"), str(folders / "all-reports"))
    bundles = {r["split"]: r for r in out.bundle.collect()}
    assert {k: r["n_samples"] for k, r in bundles.items()} == {"train": 126, "validation": 27, "test": 27, "all": 180}
    one = PH.evaluate(spark, splits, run, str(folders / "test-predictions")).bundle.first()
    assert tuple(bundles["test"])[1:] == tuple(one)
    assert out.confusion.count() == 16 and out.per_class.count() == 8
    assert {r["name"] for r in PH.compare_runs(spark, str(folders / "all-reports")).collect()} == set(bundles)
    with pytest.raises(FileNotFoundError, match="holdout"):
        PH.evaluate_splits(spark, splits, run, str(folders / "x"), splits=["test", "holdout"])


def test_all_errors_are_stored(spark, folders, tmp_path):
    rows = [(i, f"print({i})", i % 2, "x", "test") for i in range(300)]
    spark.createDataFrame(rows, "row_id long, code string, label int, language string, split string").write.parquet(str(tmp_path / "splits"))
    found = spark.range(300).selectExpr("id row_id", "int(id % 2) label", "0.5 + id / 1000 prob_ai", "int(1 - id % 2) prediction")
    found.write.parquet(str(tmp_path / "predictions"))
    top, _ = PH.analyze_errors(spark, str(tmp_path / "predictions"), str(tmp_path / "splits"), csv_path=str(tmp_path / "errors"), n=None)
    stored = [r["code"] for f in sorted((tmp_path / "errors").glob("part-*.csv")) for r in spark.read.csv(str(f), header=True).collect()]
    assert stored == [r["code"] for r in top.collect()] and len(stored) == 300


def test_missing_split(spark, folders):
    with pytest.raises(FileNotFoundError):
        A.scan_split(spark, str(folders / "splits"), "holdout")
    with pytest.raises(FileNotFoundError):
        A.scan_split(spark, str(folders / "absent"), "test")


def test_classify_files(spark, folders):
    place = folders / "texts"
    place.mkdir()
    (place / "a.py").write_text(snippet(1), encoding="utf-8")
    (place / "b.txt").write_text(" \n\t", encoding="utf-8")
    verdicts, rejects = PH.classify_files(spark, str(place), str(folders / "run"))
    v = verdicts.first()
    assert v["label_name"] == "human" and v["n_chars"] == len(snippet(1)) and abs(v["prob_ai"] + v["prob_human"] - 1) < 1e-12
    assert rejects.count() == 1 and verdicts.count() == 1
    with pytest.raises(FileNotFoundError):
        PH.classify_files(spark, str(folders / "nothing"), str(folders / "run"))


def test_stream_equals_batch_and_continues(spark, folders):
    model, config = A.load_model(spark, str(folders / "run"))
    source, sink, checkpoint = (str(folders / n) for n in ("in", "out", "checkpoint"))
    rows = A.scan_splits(spark, str(folders / "splits")).select("row_id", "label", "code")

    def run():
        ST.classify_stream(spark, source, model, sink, checkpoint, max_files_per_trigger=1).awaitTermination()
        return {r["row_id"]: r["prob_ai"] for r in spark.read.parquet(sink).collect()}

    rows.where("row_id % 2 = 0").repartition(3).write.parquet(source)
    first = run()
    rows.where("row_id % 2 = 1").repartition(2).write.mode("append").parquet(source)
    second = run()
    batch = {r["row_id"]: r["prob_ai"] for r in MO.score(rows, model, config["decision_threshold"]).collect()}
    assert second == batch and len(first) == rows.where("row_id % 2 = 0").count() and spark.read.parquet(sink).count() == len(batch)


def test_stream_rejects_as_the_batch_and_can_be_replayed(spark, folders):
    model, _ = A.load_model(spark, str(folders / "run"))
    source, sink, rejects = (str(folders / n) for n in ("in2", "out2", "rejects2"))
    data = [(i, i % 2, None if i % 7 == 0 else " \n" if i % 7 == 1 else snippet(i)) for i in range(70)]
    rows = spark.createDataFrame(data, ST.SNIPPET_SCHEMA)
    rows.repartition(3).write.parquet(source)
    ST.classify_stream(
        spark, source, model, sink, str(folders / "checkpoint2"), max_files_per_trigger=1, rejects_dir=rejects
    ).awaitTermination()

    def tables():
        return [sorted(r["row_id"] for r in spark.read.parquet(p).collect()) for p in (sink, rejects)]

    good, bad = CL.reject_blank(rows)
    assert tables() == [sorted(r["row_id"] for r in good.collect()), sorted(r["row_id"] for r in bad.collect())]
    before = tables()
    for batch in range(3):  # a batch run again, with the rows it had
        kept = [spark.read.parquet(f"{p}/batch_id={batch}").select("row_id") for p in (sink, rejects)]
        held = rows.join(kept[0].union(kept[1]), "row_id").select(*rows.columns).collect()
        again = spark.createDataFrame(held, ST.SNIPPET_SCHEMA)
        ST.write_batch(again, batch, model, sink, rejects_dir=rejects)
    assert tables() == before


def test_early_stopping_of_training(spark, folders):
    same = [MO.Candidate(0.1, 5)] * 5
    out = PH.train(spark, str(folders / "splits"), str(folders / "run2"), MO.RunConfig(num_features=256), same, limit_train=60)
    assert out.best_epoch == 1 and out.history.count() == 3


def test_a_cut_off_selection_goes_on(spark, folders, monkeypatch):
    splits, config = str(folders / "splits"), MO.RunConfig(num_features=512, early_stop_patience=3)
    candidates = [MO.Candidate(r, 10) for r in (1.0, 0.1, 0.01, 0.001)]
    fitted = []
    plain = MO._regression
    monkeypatch.setattr(MO, "_regression", lambda c: fitted.append(c.reg_param) or plain(c))

    def run(name):
        return PH.train(spark, splits, str(folders / name), config, candidates)

    def shown(selection):
        return [tuple(r)[:7] for r in selection.history.orderBy("epoch").collect()]

    whole = run("whole")
    assert fitted == [1.0, 0.1, 0.01, 0.001]

    def cut(candidate):
        if candidate.reg_param == 0.01:
            raise KeyboardInterrupt
        return plain(candidate)

    monkeypatch.setattr(MO, "_regression", cut)
    with pytest.raises(KeyboardInterrupt):
        run("cut")
    assert A.scan_history(spark, str(folders / "cut")).count() == 2
    fitted.clear()
    monkeypatch.setattr(MO, "_regression", lambda c: fitted.append(c.reg_param) or plain(c))
    resumed = run("cut")
    assert fitted == [0.01, 0.001]
    assert shown(resumed) == shown(whole) and (resumed.best_epoch, resumed.best_val_loss) == (whole.best_epoch, whole.best_val_loss)
    rows = A.scan_split(spark, splits, "test")

    def scores(model):
        return [r["prob_ai"] for r in MO.score(rows, model).orderBy("row_id").collect()]

    assert scores(resumed.model) == scores(whole.model)
    fitted.clear()
    again = run("cut")
    assert fitted == [] and shown(again) == shown(whole)
    PH.train(spark, splits, str(folders / "cut"), config, candidates[1:])
    assert fitted == [0.1, 0.01, 0.001], "other candidates are another selection"


def test_reports_of_all_kinds_are_listed(spark, folders, tmp_path):
    splits, predictions = str(folders / "splits"), str(folders / "predictions-listed")
    PH.evaluate(spark, splits, str(folders / "run"), predictions, str(tmp_path / "one"), threshold=1.1)
    top, summary = PH.analyze_errors(spark, predictions, splits, csv_path=str(tmp_path / "sub" / "wrong"), summary_path=str(tmp_path / "sum"))
    (tmp_path / "plain.CSV").write_text('a,b\n1,"x\ny"\n2,z\n')
    listed = {tuple(r) for r in PH.list_reports(spark, str(tmp_path)).collect()}
    n = summary.first()["n_errors"]
    assert n and listed == {("one", "metrics", None), ("sum", "error_summary", None), ("sub/wrong", "errors", n), ("plain", "csv", 2)}
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        PH.list_reports(spark, str(tmp_path / "none"))


def test_training_on_the_encoded_table(spark, folders):
    """Ids of all tokens tell a model as much as the texts do."""
    splits, encoded = str(folders / "splits"), str(folders / "encoded")
    PH.tokenize(spark, splits, encoded, str(folders / "vocab-all"), max_length=512, vocab_size=5_000)
    config, candidates = MO.RunConfig(num_features=1 << 14), [MO.Candidate(0.01, 20)]
    by_ids = PH.train(spark, encoded, str(folders / "run-ids"), config, candidates, encoded=True)
    assert by_ids.best_val_loss < 0.3
    out = PH.evaluate_splits(spark, encoded, str(folders / "run-ids"), str(folders / "ids-predictions"), encoded=True)
    bundles = {r["split"]: r for r in out.bundle.collect()}
    assert bundles["test"]["accuracy"] > 0.9 and bundles["all"]["n_samples"] == 180
    top, summary = PH.analyze_errors(spark, str(folders / "ids-predictions"), splits)
    assert summary.first()["n_test"] == 27 and top.count() == summary.first()["n_errors"]
