import hashlib
import random
import re

import pytest

from quillmark.llm import fill_middle as fm
from tests.llm.conftest import ODD


def brute(doc_id, text, plan):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if plan.unit == "line" else list(text)
    n = len(units)
    digest = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in (plan.prefix, plan.suffix, plan.middle)) or h[2] % 100 >= plan.rearranged:
        return (doc_id, n, "plain", None, None, text)
    if h[3] % 100 < plan.suffix_first:
        return (doc_id, n, "spm", len(p), len(m), plan.suffix + s + plan.prefix + p + plan.middle + m)
    return (doc_id, n, "psm", len(p), len(m), plan.prefix + p + plan.suffix + s + plan.middle + m)


def made(docs, plan):
    out = fm.fill_in_middle(docs, plan)
    return sorted(map(tuple, out.withColumn("restored", fm.restored("output", "form", plan)).collect()), key=repr)


def texts():
    rng = random.Random(5)
    parts = ["a", "\n", "\n\n", "é", "😀", "<", "<P", "P>", "<S", "\r\n", "line of words", "\x0b", " ", "\x80", "\x8a", "\x00", "\x09"]
    found = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    return found + ["\n" * k for k in range(20)] + ["x" * k for k in range(20)] + ["é" * k + "\n" for k in range(12)]


PLANS = [fm.Plan(), fm.Plan(unit="character"), fm.Plan(seed=1, rearranged=60, suffix_first=20, prefix="[PRE]", suffix="{SUF}", middle="(MID)")]


@pytest.mark.parametrize("plan", PLANS)
def test_against_brute_force(spark, docs_of, plan):
    marked = [(5000 + i, f"one\ntwo{m}three\n") for i, m in enumerate([plan.prefix, plan.suffix, plan.middle, "<P>"])]
    rows = [*enumerate(texts()), *ODD, *marked, (9_000, None), (9_001, "long line\n" * 50_000)]
    expected = sorted((row + ((text or ""),) for (i, text) in rows for row in [brute(i, text, plan)]), key=repr)
    assert made(docs_of(rows), plan) == expected


def test_empty_table(spark, docs_of):
    assert made(docs_of([(1, "x")]).where("doc_id > 1"), fm.Plan()) == []


@pytest.mark.parametrize("bad", [dict(prefix="<S>"), dict(middle=""), dict(prefix="aa", suffix="ba"), dict(prefix="<P", suffix="<P>"), dict(unit="word")])
def test_marks_are_checked(bad):
    with pytest.raises(ValueError):
        fm.Plan(**bad)
