import random
import re
from collections import Counter

import pytest

from quillmark.llm import collocations as co
from tests.llm.conftest import ODD


def brute(rows, settings=co.Settings()):
    """Rows of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= settings.enough}
    out = []
    for (lang, words), a in candidates.items():
        if any(
            other == lang and len(long) > len(words) and 100 * b >= settings.inside * a
            and any(long[i : i + len(words)] == words for i in range(len(long)))
            for (other, long), b in candidates.items()
        ):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, " ".join(words), a, f[lang, words[:k]], f[lang, words[k:]], n[lang], score))
    ranked = []
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine[: settings.first])]
    return sorted(ranked)


def frame(spark, rows):
    full = [(i, t, lang, "k", 1, "x", 5) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, key string, n int, phrase string, size int").repartition(4)


def random_rows(seed, count=300):
    rng = random.Random(seed)
    words = [*"ABCDE", "a", "é", "Über", "\x1c", "\xa0", "b-c", "x" * 30]
    gaps = [" "] * 12 + ["\t", "  ", ". ", ",", "\n", "\x0b", ": ", "?!", " \r\n"]
    rows = []
    for _ in range(count):
        text = "".join(rng.choices(words, weights=range(len(words), 0, -1))[0] + rng.choice(gaps) for _ in range(rng.randint(0, 120)))
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return rows + rows[:40] * 3  # copies


@pytest.mark.parametrize("settings", [co.Settings(), co.Settings(enough=3, inside=80, first=7)])
def test_against_brute_force(spark, settings):
    rows = random_rows(1)
    assert sorted(map(tuple, co.collocations(frame(spark, rows), settings).collect())) == brute(rows, settings)


def test_odd_texts(spark):
    rows = [("en", t) for _, t in ODD] + [("en", "one two three four " * 5_000), (None, None), ("fr", "x" * 200_000), ("de", "a b. " * 9), ("de", " a b")]
    assert sorted(map(tuple, co.collocations(frame(spark, rows)).collect())) == brute(rows)
    assert co.collocations(frame(spark, rows).where("doc_id < 0")).count() == 0


def test_chunks_hold_every_phrase_once(spark):
    """The dictionary alone gives back all counts, and equal passages give equal chunks."""
    rows = random_rows(2, 100)
    entries = co.chunks(frame(spark, rows)).collect()
    counted, expected = Counter(), Counter()
    for e in entries:
        pieces = [p.split(" ") for p in e.chunk.split("\n")]
        place, upto = 0, sum(map(len, pieces)) - e.overlap
        for words in pieces:
            for i in range(len(words)):
                if place + i < upto:
                    counted.update({(e.lang, *words[i : i + s]): e.n for s in (1, 2, 3) if i + s <= len(words)})
            place += len(words)
        assert e.n_words == upto
    for lang, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for s in (1, 2, 3):
                expected.update(("und" if lang is None else lang, *words[i : i + s]) for i in range(len(words) - s + 1))
    assert counted == expected
    rng = random.Random(7)
    passage = " ".join(str(rng.randrange(10**6)) for _ in range(400))
    shared = co.chunks(frame(spark, [("en", f"{i} before {passage} after {i}") for i in range(6)])).where("n = 6").count()
    assert shared > 5


def test_scores_are_exact(spark):
    big = 10**13
    df = spark.createDataFrame(
        [("en", 2, "a b", big), ("en", 1, "a", 3 * big), ("en", 1, "b", big + 7)], "lang string, size int, phrase string, f bigint"
    )
    row = co.scored_phrases(df).first()
    assert row.score == 1_000_000 * big * big // (3 * big * (big + 7))
