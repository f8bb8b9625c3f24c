"""Text quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's own features and those of the lines beside it give its potential, a table of two by
two the tie between neighbouring lines. The probabilities of a text's lines, by the forward-backward scheme and weighted
by length, make the text's quality.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.textops import Words, mix, pieces, texts

#: Labelled texts that the field is fitted on at most, those with the smallest hashed ids.
SAMPLE = 3_000
ROUNDS = 150
THRESHOLD = 0.3
_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".,;:?", "shout": b"!", "bar": b"|\t",
    "sign": b"#$%&*@^~<>{}[]=+_\\/", "space": b" ", "quote": b"\"'()-",
}
_TABLE = np.zeros((len(_KINDS) + 1, 256), np.float32)
for _i, _chars in enumerate(_KINDS.values()):
    _TABLE[_i, np.frombuffer(_chars, np.uint8)] = 1
_TABLE[-1, 128:] = 1


@dataclass
class Lines:
    """Lines of some texts: features, bytes, each text's first line. Blank lines are left out."""

    features: np.ndarray
    size: np.ndarray
    first: np.ndarray


def lines_of(found: list[bytes]) -> Lines:
    words = Words(found)
    buf = words.buf
    ends = np.flatnonzero(buf == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_end = np.cumsum(np.fromiter((len(x) + 1 for x in found), np.int64, len(found)))
    word_line = np.searchsorted(starts, words.starts, "right") - 1
    n_words = np.bincount(word_line, minlength=len(starts))
    kept = n_words > 0
    size = (ends - starts + 1).astype(np.float64)
    columns = [np.add.reduceat(row[buf], starts) / size for row in _TABLE]
    per_word = 1 / np.maximum(n_words, 1)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (word_line[1:] == word_line[:-1])
    columns.append(np.bincount(word_line, same, len(starts)) * per_word)
    marked = np.unique(mix(words.hash ^ mix(word_line.astype(np.uint64))), return_index=True)[1]
    columns.append(np.bincount(word_line[marked], minlength=len(starts)) * per_word)
    columns.append(np.minimum(np.bincount(word_line, words.ends - words.starts, len(starts)) * per_word, 40) / 10)
    columns.append(np.log1p(n_words))
    columns.append(np.log1p(size))
    # lines of the text that are the same as this one
    line_hash = np.zeros(len(starts), np.uint64)
    np.add.at(line_hash, word_line, words.hash * (np.arange(len(words.hash)) - np.searchsorted(word_line, word_line)).astype(np.uint64) * np.uint64(2) + words.hash)
    text = np.searchsorted(text_end, starts, "right")
    _, kind, many = np.unique(mix(line_hash ^ mix(text.astype(np.uint64))), return_inverse=True, return_counts=True)
    columns.append(np.log(many[kind]))
    # the two commonest shares bend: what is rare in a line may still tell
    columns += [np.sqrt(columns[i]) for i in (0, 3, 4, 5, len(_TABLE))]
    features = np.column_stack(columns)[kept].astype(np.float32)
    first = np.searchsorted(text[kept], np.arange(len(found) + 1))
    return Lines(features, size[kept], first)


@dataclass
class Field:
    """Fitted weights; ``tie`` is the score of (bad, good) beside (bad, good)."""

    middle: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    tie: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def potentials(self, lines: Lines) -> np.ndarray:
        return _beside((lines.features - self.middle) / self.scale, lines.first) @ self.weights

    def score(self, lines: Lines) -> np.ndarray:
        """Quality of each text; one without lines has none of a good line's length."""
        good = np.exp(-np.logaddexp(0, -marginals(self.potentials(lines), lines.first, self.tie)[0]))
        return 1 / (1 + np.exp(-(self.slope * _evidence(good, lines) + self.offset)))


def _evidence(good: np.ndarray, lines: Lines) -> np.ndarray:
    """Log-odds of the share of a text's length that lies in good lines."""
    sums = np.concatenate([[0], np.cumsum(good * lines.size)])
    total = np.concatenate([[0], np.cumsum(lines.size)])
    a, b = lines.first[:-1], lines.first[1:]
    share = np.clip((sums[b] - sums[a]) / np.maximum(total[b] - total[a], 1), 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def _beside(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zero at the ends), and a constant."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    inner = first[:-1][first[:-1] < first[1:]]
    before[inner] = 0
    after[first[1:][first[:-1] < first[1:]] - 1] = 0
    return np.hstack([own, before, after, np.ones((len(own), 1), own.dtype)]).astype(np.float64)


def marginals(potential: np.ndarray, first: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds that each line is good given its whole text, and the forward part of them."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = first[:-1][order], sizes[order]
    forward, backward = potential.astype(np.float64).copy(), np.zeros(len(potential))
    longest = int(sizes.max(initial=0))
    active = np.searchsorted(-sizes, -np.arange(longest + 1), "left")  # texts with more than t lines
    for t in range(1, longest):
        at = begin[: active[t]] + t
        x = forward[at - 1]
        forward[at] += np.logaddexp(x + tie[1, 1], tie[0, 1]) - np.logaddexp(x + tie[1, 0], tie[0, 0])
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        x = potential[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(x + tie[1, 1], tie[1, 0]) - np.logaddexp(x + tie[0, 1], tie[0, 0])
    return forward + backward, forward


def fit_field(lines: Lines, labels: np.ndarray, rounds: int = ROUNDS) -> Field:
    """Weights of greatest likelihood where every line has its text's label, and the scale of texts' scores."""
    middle, scale = lines.features.mean(axis=0), lines.features.std(axis=0) + 1e-3
    wide = _beside((lines.features - middle) / scale, lines.first)
    truth = np.repeat(labels, np.diff(lines.first)).astype(np.float64)
    # a text counts alike whatever the number of its lines
    weight = 1 / np.repeat(np.maximum(np.diff(lines.first), 1), np.diff(lines.first))
    inside = np.ones(len(truth), bool)
    inside[lines.first[:-1][lines.first[:-1] < lines.first[1:]]] = False
    later = np.flatnonzero(inside)
    weights, tie = np.zeros(wide.shape[1]), np.zeros((2, 2))
    values = np.concatenate([weights, tie.ravel()])
    mean, square = np.zeros_like(values), np.zeros_like(values)
    texts_n = max(1, len(lines.first) - 1)
    for turn in range(1, rounds + 1):
        weights, tie = values[:-4], values[-4:].reshape(2, 2)
        potential = wide @ weights
        odds, forward = marginals(potential, lines.first, tie)
        slope = wide.T @ ((truth - 1 / (1 + np.exp(-np.clip(odds, -50, 50)))) * weight) / texts_n - 1e-3 * weights
        ahead = odds[later] - forward[later] + potential[later]  # all from this line on
        joint = np.stack([
            tie[0, 0] + 0 * ahead, tie[0, 1] + ahead, tie[1, 0] + forward[later - 1], tie[1, 1] + forward[later - 1] + ahead,
        ])
        joint = np.exp(joint - np.logaddexp.reduce(joint, axis=0))
        seen = np.stack([(truth[later - 1] == a) & (truth[later] == b) for a in (0, 1) for b in (0, 1)])
        step = np.concatenate([slope, ((seen - joint) * weight[later]).sum(axis=1) / texts_n - 1e-2 * values[-4:]])
        mean, square = 0.9 * mean + 0.1 * step, 0.99 * square + 0.01 * step**2
        values = values + 0.1 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    field = Field(middle, scale, values[:-4], values[-4:].reshape(2, 2))
    good = 1 / (1 + np.exp(-np.clip(marginals(field.potentials(lines), lines.first, field.tie)[0], -50, 50)))
    x = np.column_stack([_evidence(good, lines), np.ones(texts_n)])
    line = np.array([1.0, 0.0])
    for _ in range(25):  # Newton's steps of a logistic regression on the texts' evidence
        p = 1 / (1 + np.exp(-np.clip(x @ line, -50, 50)))
        line += np.linalg.solve((x * (p * (1 - p) + 1e-4)[:, None]).T @ x + 0.1 * np.eye(2), x.T @ (labels - p) - 0.1 * (line - [1, 0]))
    field.slope, field.offset = float(line[0]), float(line[1])
    return field


def held_out(doc_id: str = "doc_id"):
    """Whether labels of this document are kept from fitting."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field | None:
    """The field of up to ``sample`` labelled texts that aren't held out; None without any."""
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").alias("quality")
    ).where(~held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            lines = lines_of(found)
            rows = [
                (doc, label, lines.features[a:b].tobytes(), lines.size[a:b].tobytes())
                for doc, label, a, b in zip(
                    batch.column("doc_id").to_pylist(), batch.column("quality").to_pylist(), lines.first[:-1], lines.first[1:]
                )
            ]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "quality", "features", "size"])

    rows = texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("quality").cast("int").alias("quality")).mapInArrow(
        run, "doc_id bigint, quality int, features binary, size binary"
    ).collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], bytes(r["features"])))
    if not rows:
        return None
    width = len(_TABLE) + 6 + 5
    features = np.concatenate([np.frombuffer(r["features"], np.float32).reshape(-1, width) for r in rows])
    size = np.concatenate([np.frombuffer(r["size"], np.float64) for r in rows])
    first = np.concatenate([[0], np.cumsum([len(r["size"]) // 8 for r in rows])])
    if not len(features):
        return None
    return fit_field(Lines(features, size, first), np.array([r["quality"] for r in rows], np.float64))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every text.

    The score, 0 to 1, uses the text alone; it is predicted good (1) from ``threshold`` on. Null or blank text: the score
    of a text without any good line. No usable labels: all scores 0.5. Of several labels of a document the lowest holds.
    Rows without doc_id are left out; repeated rows each come out. Empty table: no rows. Further columns don't matter.
    """
    field = train(docs, labels, sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            scores = field.score(lines_of(found)) if field else np.full(len(found), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = texts(docs).mapInArrow(run, "doc_id bigint, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
