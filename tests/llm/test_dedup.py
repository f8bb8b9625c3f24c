"""The de-duplicating operators against plain versions of what they promise."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import echoes, ngram_join, passage_dedup, repeat_dedup
from quillmark.llm.graph import components
from quillmark.llm.repeat_dedup import interval_tree, suffix_array
from quillmark.llm.textops import rolling, stretch
from quillmark.session import stored
from tests.llm.conftest import ODD


def corpus(seed, n=60):
    """Texts with copies, near copies and shared passages, some under the threshold by a little."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
        elif kind == 1:
            text = [rng.choice(words) for _ in range(rng.randint(1, 80))]
        elif kind == 2:
            text = [rng.choice(words) for _ in range(30)] + passage + [rng.choice(words) for _ in range(rng.randint(0, 9))]
        elif kind == 3:
            text = passage + [rng.choice(words) for _ in range(rng.randint(0, 12))]
        elif kind == 4:
            text = base[: rng.randint(80, 120)]
        else:
            text = ["same", "line"] * rng.randint(1, 60)
        rows.append((i * 7 % 101, " ".join(text)))
    return rows


def plain_components(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        sets.setdefault(i, []).append(s)
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and any(
                    x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]
                ):
                    label[a], changed = label[b], True
    return {(i, len(s), label[i]) for i in sets for s in sets[i]}


@pytest.mark.parametrize("rows", [corpus(1), corpus(2), ODD, []], ids=["one", "two", "odd", "empty"])
def test_ngram_components(docs_of, rows):
    got = {tuple(r) for r in ngram_join.ngram_components(docs_of(rows)).collect()}
    assert got == plain_components([r for r in rows if r[0] is not None])


def test_every_token_frequent(docs_of, monkeypatch):
    """With every shared token frequent all candidates come from pairs of tokens."""
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    rows = corpus(3)
    assert {tuple(r) for r in ngram_join.ngram_components(docs_of(rows)).collect()} == plain_components(rows)


def test_keep_one(docs_of):
    kept = ngram_join.keep_one(docs_of(ODD))
    assert kept.columns == docs_of([]).columns
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, 9, None, 10, 11, 12]))


def test_links_are_between_classes(docs_of):
    members, links = ngram_join.ngram_links(docs_of(corpus(4)))
    firsts = {r.class_id for r in members.collect()}
    found = links.collect()
    assert found and all(r.a < r.b and {r.a, r.b} <= firsts and 100 * r.shared >= 80 * r.of for r in found)


def test_components_are_found_only_after_new_links(docs_of, monkeypatch):
    """Each search for components costs the driver some ten jobs; none is made on links that were searched before."""
    seen = []
    monkeypatch.setattr(ngram_join, "components", lambda links: seen.append(links.count()) or components(links))
    rows = corpus(2)
    assert {tuple(r) for r in ngram_join.ngram_components(docs_of(rows)).collect()} == plain_components(rows)
    assert seen and all(a < b for a, b in zip(seen, seen[1:]))


def test_stored_tables_are_read_without_a_job(spark):
    """The schema of a table just written is known; reading it from the files would take a job each time."""
    rows = spark.range(5).selectExpr("id", "named_struct('x', array(id)) AS s", "cast(null AS string) AS t")
    known = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    again = stored(rows, "rows")
    alone = [i for i in spark.sparkContext.statusTracker().getJobIdsForGroup(None) if i not in known]
    assert len(alone) == 1  # the write
    assert again.dtypes == rows.dtypes and sorted(again.collect()) == sorted(rows.collect())


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_edges(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)]
    label = {i: i for e in edges for i in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert sorted(tuple(r) for r in got) == sorted(label.items())


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 4)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(31)}, **{i: 100 for i in range(100, 140)}}


def plain_passages(rows, size=13):
    first, out = {}, []
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    for i, w in texts:
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("rows", [corpus(5), corpus(6), ODD, []], ids=["one", "two", "odd", "empty"])
def test_passages(docs_of, rows):
    got = sorted(tuple(r) for r in passage_dedup.cut_repeated_passages(docs_of(rows)).collect())
    assert got == plain_passages([r for r in rows if r[0] is not None])


def plain_bytes(rows, size=50):
    first, out = {}, []
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, b in texts:
        for k in range(len(b) - size + 1):
            key = b[k : k + size]
            first[key] = min(first.get(key, i), i)
    for i, b in texts:
        gone = bytearray(len(b) + 1)
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [256, 2], ids=["usual", "hot"])
@pytest.mark.parametrize("rows", [corpus(7), ODD, []], ids=["corpus", "odd", "empty"])
def test_bytes(docs_of, rows, hot, monkeypatch):
    monkeypatch.setattr(repeat_dedup, "HOT", hot)
    cut = repeat_dedup.cut_repeats(docs_of(rows)).withColumn("kept", F.sha2("kept", 256))
    assert sorted(tuple(r) for r in cut.collect()) == plain_bytes([r for r in rows if r[0] is not None])


def test_long_passages_in_many_documents(docs_of):
    """500 bytes in 300 documents, whole, cut short at either side, with a changed byte, and twice in one text."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(100))[:500]
    rows = []
    for i in range(300):
        a, b = (0, 500) if i % 3 else (rng.randint(0, 200), rng.randint(300, 500))
        body = passage[a:b]
        if i % 5 == 0:
            at = rng.randrange(len(body))
            body = body[:at] + "#" + body[at + 1 :]
        rows.append((i, " ".join([word(), body, word(), body if i % 50 == 0 else "", word()])))
    rng.shuffle(rows)
    cut = repeat_dedup.cut_repeats(docs_of(rows)).withColumn("kept", F.sha2("kept", 256))
    assert sorted(tuple(r) for r in cut.collect()) == plain_bytes(rows)


def test_a_pack_visits_only_its_own_buckets():
    import time

    import numpy as np

    def seconds(buckets):
        best = 9.0
        for _ in range(3):
            pack = echoes._Pack(buckets, 4, 256)
            pack.add(1, 2000, np.random.default_rng(1).integers(0, 2**63, 2000).astype(np.uint64))
            start = time.perf_counter()
            rows = sum(b.num_rows for b in pack.send())
            best = min(best, time.perf_counter() - start)
            assert rows <= 2000
        return best

    assert seconds(1 << 21) < 10 * seconds(1 << 11) + 0.05


def test_suffix_array_and_intervals():
    import numpy as np

    texts = [b"abracadabra" * 3, b"xabracadabray", b"abracadabra" * 3]
    data = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    of = np.repeat(np.arange(3), [len(t) + 1 for t in texts])
    starts = np.flatnonzero(~np.isin(np.arange(len(data)), ends))
    order, common = suffix_array(data, ends, of, starts)
    suffix = lambda p: data[p : ends[of[p]]].tobytes()
    assert [suffix(p) for p in order] == sorted(suffix(p) for p in starts)
    for a, b, n in zip(order[:-1], order[1:], common[1:]):
        x, y = suffix(a), suffix(b)
        assert x[:n] == y[:n] and (n == min(len(x), len(y)) or x[n] != y[n])
    for first, last, depth, _ in interval_tree(common, 5):
        assert min(common[first + 1 : last + 1]) == depth
        assert (first == 0 or common[first] < depth) and (last + 1 == len(common) or common[last + 1] < depth)


def test_maximal_repeats_are_repeats(docs_of):
    rows = corpus(8)
    texts = {i: t.encode() for i, t in rows}
    groups = {}
    for r in repeat_dedup.maximal_repeats(docs_of(rows)).collect():
        groups.setdefault((r.group_id, r.length), set()).add((r.doc_id, r.start))
    assert groups
    for (_, length), places in groups.items():
        assert length >= 50 and len({i for i, _ in places}) > 1
        assert len({texts[i][s : s + length] for i, s in places}) == 1


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 15])
def test_chunks_hold_each_window_once_by_its_smallest_hash(monkeypatch, block):
    monkeypatch.setattr(repeat_dedup, "_BLOCK", block)
    rng = random.Random(3)
    texts = [bytes(rng.choices(b"ab", k=k)) for k in (0, 49, 50, 51, 0, 300, 7, 120, 30, 50)] + [b"x" * 200]
    chunks = repeat_dedup._Chunks(texts)
    expected, begin = [], 0
    for n, text in enumerate(texts):
        size = repeat_dedup.GRAM
        whole = b"".join(texts)
        sums, bits = rolling(np.frombuffer(whole, np.uint8)), np.uint64(len(whole).bit_length())
        last = None
        for at in range(begin, begin + len(text) - 49):
            places = np.arange(at, at + repeat_dedup._REACH)
            hashes = stretch(sums, places, places + size) >> bits
            place = int(places[np.argmin(hashes)])
            if place != last:
                expected.append([n, at, 0])
            expected[-1][2] += 1
            last = place
        begin += len(text)
    assert list(map(list, zip(chunks.text.tolist(), chunks.start.tolist(), chunks.windows.tolist()))) == expected
