"""Packing against direct tokenization, and the plan's bounds."""

import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from quillmark.llm import packing
from tests.llm.conftest import ODD

public_tokenizers = pytest.importorskip("public_tokenizers")


def sequences_are_gapless(rows, capacity=2048):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_pieces_are_the_tokenizers(docs_of, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = rows + [(20, "It's <|endoftext|> don’t 12 34 İSTANBUL ΣΣ áb, é.")] * bool(rows)
    expected = []
    for i, text in rows:
        if i is None:
            continue
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        for n, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            expected.append((i, n, a, len(part), zlib.crc32(part.tobytes())))
    got = packing.pack(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    sequences_are_gapless(got)


def test_forgetting_words_changes_nothing(monkeypatch):
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    texts = [b"some words here", b"", b"other words, there", b"some words here"]
    ids, ends = words(texts)
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    for a, b, text in zip([0, *ends[:-1]], ends, texts):
        again, _ = words([text])
        assert again.tolist() == ids[a:b].tolist()


def test_words_are_looked_up_by_their_parts():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    words(["Straße, strAße. STRAßE (12) 21 don't it\u2019s".encode()])
    assert set(words.known) == {b"\n", *(w.encode() for w in ("straße", ",", ".", "(", ")", "1", "2", "don't", "it\u2019s"))}


@pytest.mark.parametrize("seed", range(4))
def test_parts_have_the_tokenizers_ids(seed):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer, words, rng = Tokenizer.from_file(path), packing.WordIds(path), random.Random(seed)
    signs = [*"aAzZ09_.,'$<>|&;\"-\\", *"ÀÖ×Øß÷öøÿÞ", *"'s'LL", "\u0301", "\u0327", "\u00a0", "\u0085", "\u2028", "\x00", "\x1c", "\x7f", "\u00aa",
             "\u00b5", "\u0130", "\u03a3", "\u2063", "\u4e2d", "\U0001f600", "Å", "\u0661", "<|endoftext|>", "the", "Ing", " ", "\t", "\n", "\r", "\v", "\f"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(400)]
    ids, ends = words([t.encode() for t in texts])
    for a, b, text in zip([0, *ends[:-1]], ends, texts):
        assert ids[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0], repr(text)


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {}
    for _ in range(rng.choice([1, 30, 3000])):
        n = min(2048, int(rng.lognormvariate(6, 1.5)) + 1)
        counts[n] = counts.get(n, 0) + rng.randint(1, 4)
    plan = packing.packing_plan(counts)
    used = {}
    for lengths, n in plan:
        assert sum(lengths) <= 2048 and n > 0
        for length in lengths:
            used[length] = used.get(length, 0) + n
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    least = max(-(-total // 2048), sum(v for k, v in counts.items() if k > 1024))
    assert sum(n for _, n in plan) <= least * 1.02 + 1


def test_exact_complements():
    plan = packing.packing_plan({2048: 3, 2000: 5, 48: 4, 40: 2, 8: 2, 30: 1, 10: 1})
    full = [(sorted(lengths), n) for lengths, n in plan if sum(lengths) == 2048]
    assert ([2048], 3) in full and ([48, 2000], 4) in full and ([8, 40, 2000], 1) in full
    assert packing.packing_plan({}) == []


def best_fit(lengths, capacity=2048):
    """Sequences that best fit takes, the longest pieces first."""
    gaps, used = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, length)
        if at < len(gaps):
            gap = gaps.pop(at) - length
        else:
            used, gap = used + 1, capacity - length
        if gap:
            bisect.insort(gaps, gap)
    return used


@pytest.mark.parametrize("mix", ["any", "middle", "lognormal", "two kinds", "few lengths"])
def test_never_worse_than_best_fit(mix):
    rng = np.random.default_rng(1)
    lengths = {
        "any": lambda: rng.integers(1, 2049, 6000), "middle": lambda: rng.integers(500, 1001, 6000),
        "lognormal": lambda: np.clip(np.exp(rng.normal(5.5, 1.2, 6000)).astype(int) + 1, 1, 2048),
        "two kinds": lambda: np.concatenate([rng.integers(1, 100, 3000), rng.integers(1000, 2049, 3000)]),
        "few lengths": lambda: rng.choice([700, 1400, 683, 682, 300], 6000),
    }[mix]().tolist()
    plan = packing.packing_plan(Counter(lengths))
    assert Counter(x for held, n in plan for x in held * n) == Counter(lengths)
    assert all(sum(held) <= 2048 for held, _ in plan)
    assert sum(n for _, n in plan) <= best_fit(lengths)
