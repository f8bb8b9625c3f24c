"""Which hashes of a document occur in other documents, without a row for each hash.

Every task packs the hashes of its documents by bucket, as a few bytes each, and answers what it can by itself: a hash
that many of its documents share is sent on once, however hot it is. A bucket is a bounded stretch of the hash range;
the number of buckets follows the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.textops import pieces, texts

#: Hashes packed together by a task, and hashes of a bucket, about.
PACK, BUCKET = 1_500_000, 2_000_000
#: Added to the key of a hash that at least ``frequent`` documents hold.
FREQUENT = 1 << 62
_PACKED = "bucket int, docs binary, sizes binary, owner binary, rest binary, known binary"
_ANSWER = "doc_id bigint, size int, keys array<bigint>"
_U = np.uint64
#: Gives for each text its distinct hashes and its size.
Hasher = Callable[[list[bytes]], Iterable[tuple[np.ndarray, int]]]


def bucket_count(hashes: int) -> int:
    """Buckets for so many hashes; at most what leaves room for ``FREQUENT`` beside five bytes."""
    return min(max(64, -(-hashes // BUCKET)), 1 << 21)


def keys_of(hashes: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """The part of a hash that is compared: its bucket and its last ``width`` bytes (8: the hash itself)."""
    if width == 8:
        return hashes.view(np.int64)
    return ((_bucket(hashes, buckets) << _U(8 * width)) | (hashes & _U((1 << 8 * width) - 1))).view(np.int64)


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(buckets)) >> _U(32)


def _shorten(rest: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _lengthen(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.reshape(-1).view(np.uint64)


def _answers(docs: np.ndarray, sizes: np.ndarray, owner: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(owner, kind="stable")
    owner, keys = owner[order], keys[order]
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(owner)), pa.int32()), pa.array(keys, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [pa.array(docs[owner[at]], pa.int64()), pa.array(sizes[owner[at]], pa.int32()), lists], ["doc_id", "size", "keys"]
    )


class _Pack:
    """Hashes of one task's documents until they are sent on."""

    def __init__(self, buckets: int, width: int, frequent: int | None):
        self.buckets, self.width, self.frequent = buckets, width, frequent
        self.clear()

    def clear(self) -> None:
        self.docs: list[int] = []
        self.sizes: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.held = 0

    def add(self, doc: int, size: int, hashes: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(size)
        self.hashes.append(hashes)
        self.held += len(hashes)

    def full(self) -> bool:
        return self.held >= PACK or len(self.docs) >= 60_000

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return self.clear()
        docs, sizes = np.array(self.docs, np.int64), np.array(self.sizes, np.int32)
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), [len(x) for x in self.hashes])
        hashes = np.concatenate(self.hashes)
        self.clear()
        if self.frequent is None:  # the smallest document of each hash first
            by_doc = np.argsort(docs, kind="stable").astype(np.int32)
            place = np.empty_like(by_doc)
            place[by_doc] = np.arange(len(by_doc), dtype=np.int32)
            order = np.lexsort((place[owner], hashes))
        else:
            order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        counts = np.diff(np.append(starts, len(hashes)))
        if self.frequent is None:
            head = np.repeat(starts, counts)
            known = docs[owner] > docs[owner[head]]
            sent, heavy = np.zeros(len(hashes), bool), np.empty(0, np.uint64)
            sent[starts] = True
            direct = known
        else:
            direct = np.repeat(counts >= self.frequent, counts)
            sent, heavy = ~direct, hashes[starts[counts >= self.frequent]]
        if direct.any():
            keys = keys_of(hashes[direct], self.buckets, self.width)
            yield self._row(-1, answer=_answers(docs, sizes, owner[direct], keys if self.frequent is None else keys + FREQUENT))
        hashes, owner = hashes[sent], owner[sent]
        light_at, heavy_at = _bucket(hashes, self.buckets), _bucket(heavy, self.buckets)
        present = np.union1d(light_at, heavy_at)  # only these: there are far more buckets than a pack has
        cuts = [np.searchsorted(at, present, side).tolist() for at in (light_at, heavy_at) for side in ("left", "right")]
        rows = []
        for b, *edges in zip(present.tolist(), *cuts):
            part, known = slice(*edges[:2]), slice(*edges[2:])
            used, local = np.unique(owner[part], return_inverse=True)
            rows.append((
                b, docs[used].tobytes(), sizes[used].tobytes(), local.astype(np.uint16).tobytes(),
                _shorten(hashes[part], self.width), _shorten(heavy[known], self.width),
            ))
        yield self._rows(rows)

    @staticmethod
    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [()] * 6
        types = [pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "docs", "sizes", "owner", "rest", "known"]
        )

    def _row(self, bucket: int, answer: pa.RecordBatch) -> pa.RecordBatch:
        """An answer that needs nothing from other tasks, in the shape of the packed rows (one for each few documents)."""
        lists, rows = answer.column(2), []
        docs, sizes = answer.column(0).to_numpy(), answer.column(1).to_numpy()
        offsets, keys = lists.offsets.to_numpy(), lists.values.to_numpy()
        for a in range(0, len(docs), 256):
            b = min(a + 256, len(docs))
            # spread over the buckets below zero, so that no task gets them all
            rows.append((
                -1 - int(docs[a] % self.buckets), docs[a:b].tobytes(), sizes[a:b].tobytes(),
                np.diff(offsets[a : b + 1]).astype(np.uint32).tobytes(), keys[offsets[a] : offsets[b]].tobytes(), b"",
            ))
        return self._rows(rows)


def packed(docs: DataFrame, hasher: Hasher, buckets: int, width: int, frequent: int | None, copies: bool = True) -> DataFrame:
    """Packed hashes of all texts. ``copies`` False: of texts with equal hashes in a pack only the smallest id is kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, seen = _Pack(buckets, width, frequent), {}
        for batch, found in pieces(batches):
            ids = batch.column("doc_id").to_pylist()
            for doc, (hashes, size) in zip(ids, hasher(batch, found)):
                if not len(hashes):
                    continue
                if not copies:
                    digest = hash(hashes.tobytes())
                    held = seen.get(digest)
                    if held is not None and np.array_equal(pack.hashes[held], hashes):
                        pack.docs[held] = min(pack.docs[held], doc)
                        continue
                    seen[digest] = len(pack.docs)
                pack.add(doc, size, hashes)
                if pack.full():
                    yield from pack.send()
                    seen = {}
        yield from pack.send() or ()

    return docs.mapInArrow(run, _PACKED)


def settled(rows: DataFrame, width: int, frequent: int | None) -> DataFrame:
    """Answers ``(doc_id, size, keys)``, several rows for a document, from packed hashes.

    With ``frequent``: the keys at least two documents hold, ``FREQUENT`` added where at least so many do. Without: the
    keys that a document with a smaller id holds too.
    """

    def run(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        out = []
        if bucket < 0:
            for docs, sizes, owner, rest in zip(*(table.column(c).to_pylist() for c in ("docs", "sizes", "owner", "rest"))):
                counts = np.frombuffer(owner, np.uint32)
                out.append(_answers(
                    np.frombuffer(docs, np.int64), np.frombuffer(sizes, np.int32),
                    np.repeat(np.arange(len(counts)), counts), np.frombuffer(rest, np.int64),
                ))
            return pa.Table.from_batches(out)
        docs, sizes, owners, rests, known, base = [], [], [], [], [], 0
        for i in range(table.num_rows):
            d, s, o, r, k = (table.column(c)[i].as_py() for c in ("docs", "sizes", "owner", "rest", "known"))
            docs.append(np.frombuffer(d, np.int64))
            sizes.append(np.frombuffer(s, np.int32))
            owners.append(np.frombuffer(o, np.uint16).astype(np.int64) + base)
            rests.append(_lengthen(r, width))
            known.append(_lengthen(k, width))
            base += len(docs[-1])
        docs, sizes, owner = np.concatenate(docs), np.concatenate(sizes), np.concatenate(owners)
        heavy = np.concatenate(known)
        rest = np.concatenate([*rests, heavy])
        del rests, owners
        order = np.argsort(rest)
        sorted_rest = rest[order]
        starts = np.flatnonzero(np.concatenate([[True], sorted_rest[1:] != sorted_rest[:-1]]))
        spans = np.diff(np.append(starts, len(rest)))
        if frequent is None:
            smallest = np.minimum.reduceat(docs[owner][order], starts)
            take = docs[owner][order] > np.repeat(smallest, spans)
            mark = np.zeros(len(order), np.int64)
        else:
            weight = np.ones(len(rest), np.int64)
            weight[len(owner) :] = frequent
            count = np.repeat(np.add.reduceat(weight[order], starts), spans)
            take = (count >= 2) & (order < len(owner))
            mark = np.where(count >= frequent, FREQUENT, 0)
        owner = owner[order[take]] if take.any() else np.empty(0, np.int64)
        keys = sorted_rest[take].view(np.int64)
        if width < 8:
            keys = keys | (bucket << 8 * width)
        keys = keys + mark[take]
        return pa.Table.from_batches([_answers(docs, sizes, owner, keys)])

    return rows.groupBy("bucket").applyInArrow(run, _ANSWER)


def answers(rows: DataFrame, width: int, frequent: int | None) -> DataFrame:
    """One row ``(doc_id, size, keys)`` per document with an answer."""
    found = settled(rows, width, frequent)
    return found.groupBy("doc_id").agg(F.max("size").alias("size"), F.flatten(F.collect_list("keys")).alias("keys"))


def volume(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
