"""``python -m quillmark <phase> ...`` or ``spark-submit``: the phases from the command line."""

from __future__ import annotations

import argparse
import sys

from quillmark import constants as C
from quillmark.operators import model as MO
from quillmark.plans import phases as PH
from quillmark.session import build_session

# Rows printed of any report; --reports-to writes all of them.
SHOWN = 100


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quillmark", description=__doc__)
    parser.add_argument("--master", help="Spark master; default is that of the environment")
    parser.add_argument("--reports-to", help="folder for all reports in full, as JSON lines, each in a folder of its name")
    phases = parser.add_subparsers(dest="phase", required=True)

    def phase(name: str, *places: str) -> argparse.ArgumentParser:
        sub = phases.add_parser(name)
        for place in places:
            sub.add_argument(place)
        return sub

    p = phase("prepare", "raw", "interim", "splits")
    p.add_argument("--languages", nargs="+", default=list(C.PYTHON_ALIASES))
    p.add_argument("--resolve", choices=["file", "global"], default="file")
    p.add_argument("--seed", type=int, default=C.SEED)
    phase("analyze", "interim", "splits")
    p = phase("tokenize", "splits", "out", "vocab")
    p.add_argument("--max-length", type=int, default=C.MAX_TOKENS)
    p = phase("train", "splits", "run")
    p.add_argument("--max-length", type=int, default=C.MAX_TOKENS)
    p.add_argument("--threshold", type=float, default=C.THRESHOLD)
    p.add_argument("--patience", type=int, default=C.PATIENCE)
    p.add_argument("--seed", type=int, default=C.SEED)
    p.add_argument("--limit-train", type=int)
    p.add_argument("--limit-validation", type=int)
    p.add_argument("--encoded", action="store_true", help="splits is a table that tokenize has stored")
    p = phase("evaluate", "splits", "run", "predictions", "metrics")
    p.add_argument("--split", choices=[*C.SPLITS, PH.ALL], default="test", help="all: every split, and all together")
    p.add_argument("--encoded", action="store_true", help="with all: splits is a table that tokenize has stored")
    p.add_argument("--threshold", type=float)
    p = phase("errors", "predictions", "splits", "csv", "summary")
    p.add_argument("--split", choices=C.SPLITS, default="test")
    p.add_argument("--max-rows", type=int, default=C.MAX_ERROR_ROWS)
    p = phase("classify", "path", "run")
    p.add_argument("--threshold", type=float)
    p.add_argument("--out", help="folder for the verdicts, as JSON lines")
    phase("results", "reports")
    return parser


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    spark = build_session(master=a.master)
    try:
        reports = _run(spark, a)
    except (FileNotFoundError, KeyError, ValueError) as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1 if isinstance(e, FileNotFoundError) else 2
    for name, report in reports.items():
        print(f"--- {name}")
        if a.reports_to:
            report.write.mode("overwrite").json(f"{a.reports_to}/{name.replace(' ', '_')}")
        report.show(SHOWN, truncate=80)
        if len(report.take(SHOWN + 1)) > SHOWN:
            print(f"(the first {SHOWN} rows; --reports-to writes all)")
    return 0


def _run(spark, a: argparse.Namespace) -> dict:
    if a.phase == "prepare":
        return vars(PH.prepare(spark, a.raw, a.interim, a.splits, a.languages, seed=a.seed, resolve=a.resolve))
    if a.phase == "analyze":
        return vars(PH.analyze(spark, a.interim, a.splits))
    if a.phase == "tokenize":
        return {"lengths": PH.tokenize(spark, a.splits, a.out, a.vocab, a.max_length)}
    if a.phase == "train":
        config = MO.RunConfig(
            max_tokens=a.max_length, decision_threshold=a.threshold, early_stop_patience=a.patience, random_seed=a.seed
        )
        chosen = PH.train(
            spark, a.splits, a.run, config, limit_train=a.limit_train, limit_validation=a.limit_validation,
            encoded=a.encoded,
        )
        return {"history": chosen.history}
    if a.phase == "evaluate" and (a.split == PH.ALL or a.encoded):
        splits = C.SPLITS if a.split == PH.ALL else [a.split]
        out = PH.evaluate_splits(spark, a.splits, a.run, a.predictions, a.metrics, splits, a.threshold, a.encoded)
        return vars(out)
    if a.phase == "evaluate":
        return vars(PH.evaluate(spark, a.splits, a.run, a.predictions, a.metrics, a.split, a.threshold))
    if a.phase == "errors":
        top, summary = PH.analyze_errors(spark, a.predictions, a.splits, a.split, a.csv, a.summary, a.max_rows)
        return {"top errors": top, "summary": summary}
    if a.phase == "classify":
        verdicts, rejects = PH.classify_files(spark, a.path, a.run, a.threshold)
        if a.out:
            verdicts.write.mode("overwrite").json(a.out)
            return {"rejected": rejects}
        return {"verdicts": verdicts, "rejected": rejects}
    return {"runs": PH.compare_runs(spark, a.reports), "reports": PH.list_reports(spark, a.reports)}


if __name__ == "__main__":
    raise SystemExit(main())
