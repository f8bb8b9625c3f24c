"""Repeated passages by difference-cover anchors.

A passage of ``window`` words that two documents share starts at any two places. Of the places modulo a period only
those of a difference cover are hashed, three of seven: whatever the two starts are, both passages have one such place
at the same distance. Shared anchors are looked for first; only windows around them are then compared in full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm import echoes
from quillmark.llm.textops import Words, pieces, texts

#: Every difference modulo the period is one of two members of the cover.
PERIOD, COVER = 7, (0, 1, 3)
#: Words of a repeated passage at least.
WINDOW = 13
_ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_WIDTH = 4


def _anchors(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of each text's anchors, and their hashes."""
    grams = words.grams(_ANCHOR)
    for a, b in zip(words.first[:-1], words.first[1:]):
        n = b - a - WINDOW + PERIOD  # anchors of a text that is shorter than a window don't matter
        at = np.flatnonzero(_IN_COVER[np.arange(max(0, n)) % PERIOD]) if b - a >= WINDOW else np.empty(0, np.int64)
        yield at, grams[a + at] if len(at) else np.empty(0, np.uint64)


def _has(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    return keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)


def _keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for keys in batch.column("keys"):
        yield keys.values.to_numpy() if keys.is_valid else np.empty(0, np.int64)


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, keys): hashes of the windows of a document that start in a document with a smaller id too."""
    source = texts(docs)
    words = echoes.volume(docs) // 6
    buckets = echoes.bucket_count(words * len(COVER) // PERIOD)

    def anchors(batch: pa.RecordBatch, found: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
        for at, hashes in _anchors(Words(found)):
            yield np.unique(hashes), len(at)

    shared = echoes.answers(echoes.packed(source, anchors, buckets, _WIDTH, 2), _WIDTH, 2)

    def windows(batch: pa.RecordBatch, found: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
        words = Words(found)
        grams = words.grams(WINDOW)
        for (at, hashes), keys, a, b in zip(_anchors(words), _keys(batch), words.first[:-1], words.first[1:]):
            hit = at[_has(echoes.keys_of(hashes, buckets, _WIDTH), keys & (echoes.FREQUENT - 1))]
            n = b - a - WINDOW + 1
            near = np.zeros(max(0, n) + 1, np.int64)
            np.add.at(near, np.clip(hit - PERIOD + 1, 0, None), 1)
            np.add.at(near, np.minimum(hit + 1, n), -1)
            yield np.unique(grams[a : a + max(0, n)][np.cumsum(near[:-1]) > 0]), len(hit)

    around = echoes.packed(source.join(shared.select("doc_id", "keys"), "doc_id"), windows, buckets, 8, None)
    return echoes.answers(around, 8, None).select("doc_id", "keys")


def cut_repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): each text without the words that a repeated window covers.

    Words are runs without ASCII white space, unchanged; ``kept`` joins those left by one space. A window is repeated
    where its words also start in a document with a smaller doc_id, judged on the input; rows with one doc_id don't
    repeat each other. Null or blank text: no words, empty. Rows without doc_id are left out. Empty table: no rows.
    Further columns of ``docs`` don't matter.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            counts, removed, kept = [], [], []
            for text, keys in zip(found, _keys(batch)):
                plain = text.split()
                gone = np.zeros(len(plain), bool)
                if len(keys):
                    hit = np.flatnonzero(_has(Words([text]).grams(WINDOW).view(np.int64), keys))
                    edge = np.zeros(len(plain) + 1, np.int64)
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + WINDOW, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    plain = [w for w, g in zip(plain, gone.tolist()) if not g]
                counts.append(len(gone))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(plain))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    both = texts(docs).join(repeated_windows(docs), "doc_id", "left")
    return both.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept string")
