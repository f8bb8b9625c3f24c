"""Repeated byte strings by common-prefix intervals of enhanced suffix arrays.

Every window of ``WINDOW`` bytes has a minimizer, the smallest hash of the byte n-grams in it; equal windows have equal
ones. Neighbouring windows with one minimizer make a chunk. Of chunks whose minimizer occurs in several documents, those
that a smaller document has as a whole are settled by their digests; no bytes are sent for them. Where a minimizer still
has unlike chunks, they meet by it: for each bounded share of minimizers a suffix array with common-prefix lengths is
built over the distinct chunks, and a scan with a stack gives the tree of intervals of suffixes with a common prefix. An
interval at least ``WINDOW`` deep has all occurrences of a repeated string, not only neighbouring ones; those whose
occurrences all go on alike to the left belong to a longer repeat and are passed over.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import echoes
from quillmark.llm.textops import mix, pieces, powers, rolling, stretch, texts

WINDOW, GRAM = 50, 24
_REACH = WINDOW - GRAM + 1
_BASE = 0x5851F42D4C957F2D
_WIDTH = 4
#: Windows of a minimizer that at least so many documents have meet by their own bytes, one by one.
HOT = 256
#: Windows whose hashes are worked out at once, so that they stay in the processor's cache.
_BLOCK = 1 << 15
#: Bytes of chunks that a task packs together, and bytes of text for each bucket.
PACK, BUCKET = 8 << 20, 4 << 20
_CHUNKS = "bucket int, docs binary, doc binary, start binary, windows binary, before binary, group binary, bytes binary"
_SPANS = "doc_id bigint, starts array<bigint>, ends array<bigint>"


class _Chunks:
    """Chunks of some texts: text, first window, number of windows, minimizer's hash."""

    def __init__(self, found: list[bytes]):
        self.buf = np.frombuffer(b"".join(found), np.uint8)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.ends = np.cumsum(sizes)
        self.begins = self.ends - sizes
        n = len(self.buf)
        self.sums = rolling(self.buf) if n else np.zeros(1, np.uint64)
        empty = np.empty(0, np.int64)
        self.text = self.start = self.windows = empty
        self.group = np.empty(0, np.uint64)
        if n < WINDOW:
            return
        count = n - WINDOW + 1
        head, valid = np.zeros(count, bool), np.ones(count, bool)
        head[self.begins[sizes >= WINDOW]] = True
        over = np.maximum(self.begins, self.ends - WINDOW + 1)  # windows from here on reach into the next text
        valid[_ragged(over, np.maximum(np.minimum(self.ends, count) - over, 0))] = False
        bits, last = np.uint64(int(n).bit_length()), np.uint64(n)
        starts, places = [], []
        for a in range(0, count, _BLOCK):
            b = min(a + _BLOCK, count)
            place = self._lowest(a, b, bits)
            first = np.diff(place, prepend=last) != 0
            first |= head[a:b]
            first &= valid[a:b]
            found = np.flatnonzero(first)
            starts.append(found + a)
            places.append(place[found])
            last = place[-1]
        self.start, place = np.concatenate(starts), np.concatenate(places).view(np.int64)
        self.text = np.searchsorted(self.ends, self.start, "right")
        self.windows = np.minimum(np.append(self.start[1:], count), self.ends[self.text] - WINDOW + 1) - self.start
        # small hashes are chosen: spread them anew
        self.group = mix(stretch(self.sums, place, place + GRAM) ^ np.uint64(_BASE))

    def _lowest(self, a: int, b: int, bits: np.uint64) -> np.ndarray:
        """The places of the smallest hashes in the windows from ``a`` up to ``b``; of equal hashes the first."""
        end = b + _REACH - 1
        down = powers(len(self.sums))[1][a:end]
        grams = mix((self.sums[a + GRAM : end + GRAM] - self.sums[a:end]) * down + np.uint64(GRAM))
        low = ((grams >> bits) << bits) | np.arange(a, end, dtype=np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[: len(low) - (_REACH - 16)], low[_REACH - 16 :])
        return low & ((np.uint64(1) << bits) - np.uint64(1))

    def cut(self, keep: np.ndarray, single: np.ndarray) -> None:
        """Keep some chunks; ``single`` ones are cut into their windows, which then meet by their own hash."""
        repeat = np.where(single, self.windows, 1)[keep]
        step = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        alone = np.repeat(single[keep], repeat)
        start = np.repeat(self.start[keep], repeat) + step
        windows = np.where(alone, 1, np.repeat(self.windows[keep], repeat))
        group = np.repeat(self.group[keep], repeat)
        group[alone] = mix(stretch(self.sums, start[alone], start[alone] + WINDOW))
        self.text, self.start, self.windows, self.group = np.repeat(self.text[keep], repeat), start, windows, group

    def digest(self) -> np.ndarray:
        return mix(stretch(self.sums, self.start, self.start + self.windows + WINDOW - 1) ^ self.group)

    def before(self) -> np.ndarray:
        """The byte before each chunk, 256 at the start of a text."""
        return np.where(self.start == self.begins[self.text], 256, self.buf[np.maximum(self.start - 1, 0)]).astype(np.uint16)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places from each start on, one stretch after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _distinct(values: np.ndarray) -> np.ndarray:
    """The distinct values, ascending."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def _among(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    """Which values are in ``ascending``, which isn't empty."""
    at = np.searchsorted(ascending, values)
    at[at == len(ascending)] = 0
    return ascending[at] == values


def _held(batch: pa.RecordBatch, column: str, chunks: _Chunks, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which chunks have their value of ``own`` in their text's list in ``column``, and which have it there as frequent."""
    keep, frequent = np.zeros(len(own), bool), np.zeros(len(own), bool)
    edge = np.searchsorted(chunks.text, np.arange(batch.num_rows + 1)).tolist()
    lists = batch.column(column)
    values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy().tolist()
    filled = lists.is_valid().to_pylist()
    marked = column != "settled" and bool((values[cuts[0] : cuts[-1]] >= echoes.FREQUENT).any())  # whole digests carry no mark
    for a, b, c, d, known in zip(edge, edge[1:], cuts, cuts[1:], filled):
        if a == b or c == d or not known:
            continue
        keys = np.sort(values[c:d])
        keep[a:b] = _among(own[a:b], keys)
        hot = keys[np.searchsorted(keys, echoes.FREQUENT) :] - echoes.FREQUENT if marked else ()
        if len(hot):
            frequent[a:b] = _among(own[a:b], hot)
            keep[a:b] |= frequent[a:b]
    return keep, frequent


def _marked(batches: Iterable[pa.RecordBatch], buckets: int) -> Iterator[tuple[np.ndarray, _Chunks]]:
    """Doc ids and chunks of texts with the minimizers they share."""
    for batch, found in pieces(batches):
        chunks = _Chunks(found)
        chunks.cut(*_held(batch, "keys", chunks, echoes.keys_of(chunks.group, buckets, _WIDTH)))
        yield batch.column("doc_id").to_numpy(), chunks


def _by_text(values: np.ndarray, chunks: _Chunks, keep: np.ndarray, texts_n: int) -> Iterator[tuple[np.ndarray, int]]:
    """Of each text the distinct values of the chunks to keep."""
    values, edge = values[keep], np.searchsorted(chunks.text[keep], np.arange(texts_n + 1))
    for a, b in zip(edge[:-1], edge[1:]):
        yield _distinct(values[a:b]), b - a


def _settled(marked: DataFrame, minimizers: int) -> DataFrame:
    """``marked`` with the digests of chunks that a smaller document has too, and the minimizers of unlike chunks.

    Of each distinct chunk only the smallest document counts for the latter; where a minimizer is left with one document,
    none of its chunks has to be compared by its bytes.
    """

    def digests(batch: pa.RecordBatch, found: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
        chunks = _Chunks(found)
        keep, _ = _held(batch, "keys", chunks, echoes.keys_of(chunks.group, minimizers, _WIDTH))
        return _by_text(chunks.digest(), chunks, keep, len(found))

    def groups(batch: pa.RecordBatch, found: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
        chunks = _Chunks(found)
        keep, _ = _held(batch, "keys", chunks, echoes.keys_of(chunks.group, minimizers, _WIDTH))
        done, _ = _held(batch, "settled", chunks, chunks.digest().view(np.int64))
        return _by_text(chunks.group, chunks, keep & ~done, len(found))

    known = echoes.answers(echoes.packed(marked, digests, minimizers, 8, None), 8, None)
    marked = marked.join(known.select("doc_id", F.col("keys").alias("settled")), "doc_id", "left")
    unlike = echoes.answers(echoes.packed(marked, groups, minimizers, _WIDTH, HOT), _WIDTH, HOT)
    return marked.join(unlike.select("doc_id", F.col("keys").alias("unlike")), "doc_id", "left").drop("keys")


def _span_batch(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    at = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.empty(0, np.int64)
    cuts = pa.array(np.append(at, len(docs)), pa.int32())
    lists = [pa.ListArray.from_arrays(cuts, pa.array(x, pa.int64())) for x in (starts, ends)]
    return pa.RecordBatch.from_arrays([pa.array(docs[at], pa.int64()), *lists], ["doc_id", "starts", "ends"])


def _answered(docs: np.ndarray, start: np.ndarray, windows: np.ndarray, buckets: int) -> list[tuple]:
    """Rows of chunks that need no comparison, neighbouring ones joined, spread over the buckets below zero."""
    order = np.lexsort((start, docs))
    docs, start, windows = docs[order], start[order], windows[order].astype(np.int64)
    if not len(docs):
        return []
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (start[1:] != start[:-1] + windows[:-1])]))
    docs, start, windows = docs[new], start[new], np.add.reduceat(windows, new)
    return [
        (
            -1 - int(docs[a] % buckets), docs[a : a + 4096].tobytes(), b"", start[a : a + 4096].astype(np.int32).tobytes(),
            windows[a : a + 4096].astype(np.uint32).tobytes(), b"", b"", b"",
        )
        for a in range(0, len(docs), 4096)
    ]


def _packed_chunks(marked: DataFrame, minimizers: int, buckets: int) -> DataFrame:
    """Chunks by bucket. Of equal chunks in a pack only those of the smallest document go on; the others are answered.

    Of texts from ``_settled`` the settled chunks are answered and only those with unlike ones to meet go on.
    """
    settled = "settled" in marked.columns

    def send(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, start, windows, before, group, digest = (np.concatenate(x) for x in list(zip(*held))[:6])
        data = np.concatenate([x[6] for x in held])
        sizes = windows + WINDOW - 1
        at = np.cumsum(sizes) - sizes
        order = np.lexsort((docs, digest))
        first = np.concatenate([[True], digest[order][1:] != digest[order][:-1]])
        least = docs[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
        answered = order[docs[order] > least]
        sent = order[docs[order] == least]
        rows = _answered(docs[answered], start[answered], windows[answered], buckets)
        bucket = ((group >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        sent = sent[np.argsort(bucket[sent], kind="stable")]
        present, cuts = np.unique(bucket[sent], return_index=True)
        for b, part in zip(present.tolist(), np.split(sent, cuts[1:])):
            used, local = np.unique(docs[part], return_inverse=True)
            rows.append((
                b, used.tobytes(), local.astype(np.uint32).tobytes(), start[part].astype(np.int32).tobytes(),
                windows[part].astype(np.uint16).tobytes(), before[part].tobytes(), group[part].tobytes(),
                pa.compress(data[_ragged(at[part], sizes[part])].tobytes(), "zstd", asbytes=True),
            ))
        return shaped(rows)

    def shaped(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), *[pa.binary()] * 7]
        names = [c.split()[0] for c in _CHUNKS.split(", ")]
        for a in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[a : a + 64]), types)], names)

    def unlike(batches: Iterable[pa.RecordBatch], done: list[tuple]) -> Iterator[tuple[np.ndarray, _Chunks]]:
        for batch, found in pieces(batches):
            chunks, ids = _Chunks(found), batch.column("doc_id").to_numpy()
            known, _ = _held(batch, "settled", chunks, chunks.digest().view(np.int64))
            done.append((ids[chunks.text[known]], (chunks.start - chunks.begins[chunks.text])[known], chunks.windows[known]))
            keep, single = _held(batch, "unlike", chunks, echoes.keys_of(chunks.group, minimizers, _WIDTH))
            chunks.cut(keep & ~known, single)
            yield ids, chunks

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, done = [], 0, []
        for ids, chunks in unlike(batches, done) if settled else _marked(batches, minimizers):
            for part in done:
                yield from shaped(_answered(*part, buckets))
            done.clear()
            if not len(chunks.start):
                continue
            data = chunks.buf[_ragged(chunks.start, chunks.windows + WINDOW - 1)]
            held.append((
                ids[chunks.text], chunks.start - chunks.begins[chunks.text], chunks.windows, chunks.before(), chunks.group,
                chunks.digest(), data,
            ))
            size += len(data)
            if size >= PACK:
                yield from send(held)
                held, size = [], 0
        if held:
            yield from send(held)

    return marked.mapInArrow(run, _CHUNKS)


def _same(key: np.ndarray) -> np.ndarray:
    """Ranks of values, equal ones alike."""
    order = np.argsort(key)
    ranks = np.empty(len(key), np.int64)
    ranks[order] = np.cumsum(np.concatenate([[0], key[order][1:] != key[order][:-1]]))
    return ranks


def suffix_array(data: np.ndarray, ends: np.ndarray, of: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of the suffixes there, and each one's common prefix with the suffix before it.

    ``data`` holds strings each followed by one byte that isn't read, at ``ends``; ``of`` is the string of each byte.
    Ranks of stretches of 7, 14, 28, 56 bytes come from those half as long; strings of more than 112 bytes compare
    alike beyond that.
    """
    n = len(data)
    stop = ends[of]
    symbols = data.astype(np.uint64) + np.uint64(1)
    symbols[ends] = 0
    key, here = np.zeros(n, np.uint64), np.arange(n)
    for j in range(7):
        key = (key << np.uint64(9)) | symbols[np.minimum(here + j, stop)]
    ranks = {7: _same(key)}
    for size in (7, 14, 28):
        half = ranks[size]
        ranks[2 * size] = _same((half << 32) | half[np.minimum(here + size, stop)])
    half = ranks[56]
    order = starts[np.argsort((half[starts] << 32) | half[np.minimum(starts + 56, stop[starts])], kind="stable")]
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    for size in (56, 28, 14, 7):
        x, y = np.minimum(a + common, stop[a]), np.minimum(b + common, stop[b])
        common += np.where(ranks[size][x] == ranks[size][y], size, 0)
    for _ in range(6):
        x, y = np.minimum(a + common, stop[a]), np.minimum(b + common, stop[b])
        common += (symbols[x] == symbols[y]) & (symbols[x] > 0)
    common = np.minimum(common, np.minimum(stop[a] - a, stop[b] - b))
    return order, np.concatenate([[0], common])


def interval_tree(common: np.ndarray, least: int) -> list[tuple[int, int, int, bool]]:
    """(first, last, depth, outermost) of all intervals of suffixes with a common prefix of ``least`` bytes or more."""
    out, stack = [], []
    deep = np.flatnonzero(common >= least)
    before = -2
    for i, depth in zip(deep.tolist(), common[deep].tolist()):
        if i != before + 1:
            while stack:
                first, held = stack.pop()
                out.append((first, before, held, not stack))
        first = i - 1
        while stack and stack[-1][1] > depth:
            first, held = stack.pop()
            out.append((first, i - 1, held, False))
        if not stack or stack[-1][1] < depth:
            stack.append((first, depth))
        before = i
    while stack:
        first, held = stack.pop()
        out.append((first, before, held, not stack))
    return out


class _Bucket:
    """All chunks of a bucket: distinct ones, the smallest document of each window, the intervals."""

    def __init__(self, table: pa.Table):
        docs, base, parts = [], 0, {k: [] for k in ("doc", "start", "windows", "before", "group", "bytes")}
        kinds = {"start": np.int32, "windows": np.uint16, "before": np.uint16, "group": np.uint64, "bytes": np.uint8}
        for i in range(table.num_rows):
            row = {c: table.column(c)[i].as_py() for c in ("docs", *parts)}
            docs.append(np.frombuffer(row["docs"], np.int64))
            parts["doc"].append(np.frombuffer(row["doc"], np.uint32).astype(np.int64) + base)
            whole = int(np.frombuffer(row["windows"], np.uint16).astype(np.int64).sum()) + len(row["windows"]) // 2 * (WINDOW - 1)
            row["bytes"] = pa.decompress(row["bytes"], whole, "zstd", asbytes=True)
            for k, kind in kinds.items():
                parts[k].append(np.frombuffer(row[k], kind))
            base += len(docs[-1])
        whole = {k: np.concatenate(v) for k, v in parts.items()}
        self.doc, self.start = np.concatenate(docs)[whole["doc"]], whole["start"].astype(np.int64)
        self.windows = whole["windows"].astype(np.int64)
        sizes = self.windows + WINDOW - 1
        at = np.cumsum(sizes) - sizes
        sums = rolling(whole["bytes"])
        digest = mix(stretch(sums, at, at + sizes) ^ whole["group"])
        del sums
        self.digests, head, self.kind = np.unique(digest, return_index=True, return_inverse=True)
        self.count = self.windows[head]
        #: Of each distinct chunk: its first window among all distinct chunks' windows, the smallest document.
        self.begin = np.cumsum(self.count) - self.count
        self.least = np.full(len(head), np.iinfo(np.int64).max)
        np.minimum.at(self.least, self.kind, self.doc)
        #: Of each window: bytes from there on that a smaller document than ``least`` has too.
        self.reach = np.zeros(self.count.sum(), np.int64)
        # a chunk that is the only one of its minimizer has no other to share a part with
        group = whole["group"][head]
        _, kind, many = np.unique(group, return_inverse=True, return_counts=True)
        self.several = np.flatnonzero(many[kind] > 1)
        picked, size = head[self.several], sizes[head[self.several]]
        self.intervals, self.order = [], np.empty(0, np.int64)
        if not len(picked):
            return
        ends = np.cumsum(size + 1) - 1
        begin = ends - size
        data = np.zeros(ends[-1] + 1, np.uint8)
        data[_ragged(begin, size)] = whole["bytes"][_ragged(at[picked], size)]
        of = np.repeat(np.arange(len(picked)), size + 1)
        count = self.count[self.several]
        starts = _ragged(begin, count)
        order, common = suffix_array(data, ends, of, starts)
        #: Of each suffix in order: its window among all distinct chunks' windows.
        self.order = self.begin[self.several][of[order]] + order - begin[of[order]]
        self.intervals = interval_tree(common, WINDOW)
        inside = order > begin[of[order]]
        before = np.where(inside, data[order - 1], whole["before"][picked][of[order]])
        self.changes = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
        self._reach(self.several[of[order]], np.where(inside, before.astype(np.int64), -1 - order))

    def _reach(self, kind: np.ndarray, before: np.ndarray) -> None:
        """Reach of the windows from the intervals that can't be made longer to the left within all their chunks.

        Where all occurrences follow the same byte inside their chunks, the interval of the string with that byte has the
        same ones and covers them. The first window of a chunk has no such byte (``before`` is unique there).
        """
        changes = np.cumsum(np.concatenate([[0], before[1:] != before[:-1]]))
        found = np.array([x[:3] for x in self.intervals], np.int64).reshape(-1, 3)
        found = found[changes[found[:, 1]] > changes[found[:, 0]]]
        docs = self.least[kind]
        for a in range(0, len(found), 20_000):
            first, last, depth = found[a : a + 20_000].T
            size = last - first + 1
            place = _ragged(first, size)
            low = np.repeat(np.minimum.reduceat(docs[place], np.cumsum(size) - size), size)
            hit = low < docs[place]
            np.maximum.at(self.reach, self.order[place[hit]], np.repeat(depth, size)[hit])


def _spans_of(table: pa.Table) -> pa.Table:
    """Spans of the chunks and repeats that a smaller document holds too."""
    if table.column("bucket")[0].as_py() < 0:
        docs, start, windows = (
            np.concatenate([np.frombuffer(x, kind) for x in table.column(c).to_pylist()]).astype(np.int64)
            for c, kind in (("docs", np.int64), ("start", np.int32), ("windows", np.uint32))
        )
        return pa.Table.from_batches([_span_batch(docs, start, start + windows + WINDOW - 1)])
    bucket = _Bucket(table)
    whole = bucket.doc > bucket.least[bucket.kind]
    docs, starts = [bucket.doc[whole]], [bucket.start[whole]]
    ends = [(bucket.start + bucket.windows + WINDOW - 1)[whole]]
    rest = np.flatnonzero(~whole)
    for a in range(0, len(rest), 100_000):
        part = rest[a : a + 100_000]
        count = bucket.windows[part]
        reach = bucket.reach[_ragged(bucket.begin[bucket.kind[part]], count)]
        hit = np.flatnonzero(reach)
        if not len(hit):
            continue
        owner = np.repeat(np.arange(len(part)), count)[hit]
        place = (owner << 32) + _ragged(bucket.start[part], count)[hit]
        end = np.maximum.accumulate(place + reach[hit])
        new = np.concatenate([[True], place[1:] > end[:-1]])
        docs.append(bucket.doc[part][owner[new]])
        starts.append(place[new] & 0xFFFFFFFF)
        ends.append(end[np.concatenate([new[1:], [True]])] & 0xFFFFFFFF)
    return pa.Table.from_batches([_span_batch(*map(np.concatenate, (docs, starts, ends)))])


def _sharing(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Texts with the minimizers that another document has too; numbers of buckets of minimizers and of chunks."""
    size = echoes.volume(docs)
    minimizers = echoes.bucket_count(2 * size // (_REACH + 1))

    def hasher(batch: pa.RecordBatch, found: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
        chunks = _Chunks(found)
        edge = np.searchsorted(chunks.text, np.arange(len(found) + 1))
        for a, b in zip(edge[:-1], edge[1:]):
            yield _distinct(chunks.group[a:b]), b - a

    shared = echoes.answers(echoes.packed(texts(docs), hasher, minimizers, _WIDTH, HOT), _WIDTH, HOT)
    return texts(docs).join(shared.select("doc_id", "keys"), "doc_id"), minimizers, max(64, -(-size // BUCKET))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, starts, ends): bytes covered by windows that a document with a smaller id holds too; spans may overlap."""
    marked, minimizers, buckets = _sharing(docs)
    spans = _packed_chunks(_settled(marked, minimizers), minimizers, buckets).groupBy("bucket").applyInArrow(_spans_of, _SPANS)
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return spans.groupBy("doc_id").agg(flat("starts"), flat("ends"))


def maximal_repeats(docs: DataFrame) -> DataFrame:
    """(group_id, length, doc_id, start): repeated strings around one minimizer with all their occurrences.

    A group is an interval whose strings differ in the byte before, or a chunk that several documents have: it can't be
    made longer to the left, or as an interval to the right. A longer repeat shows as groups that follow each other.
    ``start`` counts bytes of the UTF-8 text. Occurrences are joined to groups, so no task holds all of a group.
    """
    marked, minimizers, buckets = _sharing(docs)

    def occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunks in _marked(batches, minimizers):
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks.digest().view(np.int64)), pa.array(ids[chunks.text], pa.int64()),
                 pa.array(chunks.start - chunks.begins[chunks.text], pa.int64())],
                ["chunk", "doc_id", "place"],
            )

    def groups(table: pa.Table) -> pa.Table:
        rows = []
        if table.column("bucket")[0].as_py() >= 0:
            bucket = _Bucket(table)
            kinds = np.repeat(np.arange(len(bucket.count)), bucket.count)
            for first, last, depth, _ in bucket.intervals:
                if bucket.changes[last] > bucket.changes[first]:
                    places = bucket.order[first : last + 1]
                    name = int(bucket.digests[kinds[places]].min() ^ np.uint64(depth << 1))
                    rows += [(name, depth, int(bucket.digests[kinds[p]]), int(p - bucket.begin[kinds[p]])) for p in places.tolist()]
            rows += [(int(d), int(c) + WINDOW - 1, int(d), 0) for d, c in zip(bucket.digests.tolist(), bucket.count.tolist())]
        columns = list(zip(*rows)) or [()] * 4
        return pa.Table.from_arrays(
            [pa.array(np.array(columns[0], np.uint64).view(np.int64)), pa.array(columns[1], pa.int64()),
             pa.array(np.array(columns[2], np.uint64).view(np.int64)), pa.array(columns[3], pa.int64())],
            ["group_id", "length", "chunk", "inside"],
        )

    found = _packed_chunks(marked, minimizers, buckets).groupBy("bucket").applyInArrow(
        groups, "group_id bigint, length bigint, chunk bigint, inside bigint"
    )
    places = marked.mapInArrow(occurrences, "chunk bigint, doc_id bigint, place bigint")
    rows = found.join(places, "chunk").select("group_id", "length", "doc_id", (F.col("place") + F.col("inside")).alias("start")).distinct()
    several = rows.groupBy("group_id", "length").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    return rows.join(several.select("group_id", "length"), ["group_id", "length"]).select("group_id", "length", "doc_id", "start")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's UTF-8 bytes without those in a repeated window.

    A window of 50 bytes is repeated where its bytes also start in a document with a smaller doc_id, overlaps included,
    judged on the input; rows with one doc_id don't repeat each other. ``n_spans`` counts maximal removed runs. Null
    text: no bytes. Rows without doc_id are left out. Empty table: no rows. Further columns of ``docs`` don't matter.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            out = []
            for text, starts, ends in zip(found, batch.column("starts"), batch.column("ends")):
                if not starts.is_valid:
                    out.append((len(text), 0, 0, text))
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, starts.values.to_numpy(), 1)
                np.add.at(edge, ends.values.to_numpy(), -1)
                gone = np.cumsum(edge[:-1]) > 0
                spans = int(np.count_nonzero(np.diff(gone.view(np.int8), prepend=np.int8(0)) == 1))
                out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    both = texts(docs).join(repeated_spans(docs), "doc_id", "left")
    return both.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
