"""Severity of toxic language by ordinal regression with cumulative links.

Grades run from 0, clean, to 3, severe. One set of weights over the features of a text serves all grades; each step from a
grade to the next has its own threshold: P(grade >= k) = sigmoid(w x - threshold_k). Labels only tell clean from toxic, so
the grades of toxic texts are thirds by what they hold of the features that labels tie to toxicity.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.textops import Words, pieces, rolling, stretch, texts
from quillmark.session import stored

#: Labelled texts that the regression is fitted on at most, those with the smallest hashed ids.
SAMPLE = 20_000
#: Texts a feature must be found in, how far above chance its toxic ones, the odds of toxic with it to those without it, and
#: features at most, those with the best ties.
LEAST, TIE, ODDS, FEATURES = 5, 6.0, 4.0, 400
#: Beside whole words their first so many bytes are features: inflected forms share them.
PREFIXES = (4, 5, 6)
ROUNDS = 300
GRADES = 4
#: Probability of any grade above clean from which a text counts as toxic.
REJECT = 0.3
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TABLE = np.where(_LETTERS, np.arange(256), 32).astype(np.uint8).tobytes()


def _features(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of some texts, and the text of each: lower-case words of letters only, and how they begin."""
    words = Words([x.translate(_TABLE) for x in found], lower=True)
    text = np.repeat(np.arange(len(found)), np.diff(words.first))
    sums, size = rolling(words.buf), words.ends - words.starts
    hashes, of = [words.hash], [text]
    for n in PREFIXES:
        longer = np.flatnonzero(size > n)
        hashes.append(stretch(sums, words.starts[longer], words.starts[longer] + n))
        of.append(text[longer])
    return np.concatenate(hashes), np.concatenate(of)


def _counts(found: list[bytes], terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in ``terms``, how often) of the features among ``terms``, which ascend."""
    hashes, text = _features(found)
    if not len(terms):
        return (np.empty(0, np.int64),) * 3
    at = np.searchsorted(terms, hashes)
    at[at == len(terms)] = 0
    hit = terms[at] == hashes
    pairs, many = np.unique(text[hit] * len(terms) + at[hit], return_counts=True)
    return pairs // len(terms), pairs % len(terms), many


@dataclass
class Severity:
    """Hashes of the features that count, ascending, their weights, thresholds between grades."""

    terms: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, found: list[bytes]) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ... of each text."""
        text, term, many = _counts(found, self.terms)
        sums = np.bincount(text, self.weights[term] * np.log1p(many), len(found))
        return 1 / (1 + np.exp(-np.clip(sums[:, None] - self.thresholds, -50, 50)))


def fit_severity(
    text: np.ndarray, term: np.ndarray, many: np.ndarray, toxic: np.ndarray, terms: np.ndarray, rounds: int = ROUNDS
) -> Severity:
    """The regression on (text, place in ``terms``, how often) of texts that are toxic or not."""
    n, positive = len(toxic), max(1.0, float(toxic.sum()))
    value = np.log1p(many)
    # grades of toxic texts: thirds by what they hold of those words
    load = np.bincount(text, value, n)
    cuts = np.quantile(load[toxic > 0], [1 / 3, 2 / 3]) if toxic.any() else [0.0, 0.0]
    grade = np.where(toxic > 0, 1 + (load > cuts[0]) + (load > cuts[1]), 0)
    values = np.concatenate([np.zeros(len(terms)), [1.0, 0.0, 0.0]])
    mean, square = np.zeros_like(values), np.zeros_like(values)
    level = np.arange(1, GRADES)
    for turn in range(1, rounds + 1):
        weights, gaps = values[: len(terms)], values[len(terms) :]
        # thresholds rise: each is the one before and a positive step
        steps = np.exp(gaps[1:])
        cut = np.concatenate([[gaps[0]], gaps[0] + np.cumsum(steps)])
        sums = np.bincount(text, weights[term] * value, n)
        reach = np.column_stack([np.ones(n), 1 / (1 + np.exp(-np.clip(sums[:, None] - cut, -50, 50))), np.zeros(n)])
        rows = np.arange(n)
        here = np.maximum(reach[rows, grade] - reach[rows, grade + 1], 1e-12)
        low, high = reach[rows, grade] * (1 - reach[rows, grade]), reach[rows, grade + 1] * (1 - reach[rows, grade + 1])
        to_sum = (low - high) / here
        to_cut = np.zeros(GRADES - 1)
        for k in level:
            to_cut[k - 1] = ((-low / here) * (grade == k) + (high / here) * (grade == k - 1)).sum()
        back = np.array([to_cut.sum(), *[to_cut[k:].sum() * steps[k - 1] for k in range(1, GRADES - 1)]])
        step = np.concatenate([np.bincount(term, to_sum[text] * value, len(terms)) / positive - 1e-3 * weights, back / positive])
        mean, square = 0.9 * mean + 0.1 * step, 0.99 * square + 0.01 * step**2
        values = values + 0.08 * (mean / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
    gaps = values[len(terms) :]
    cut = np.concatenate([[gaps[0]], gaps[0] + np.cumsum(np.exp(gaps[1:]))])
    return Severity(terms, values[: len(terms)], cut)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Severity | None:
    """The regression fitted on up to ``sample`` labelled texts, equal ones once; None without both labels or any feature."""
    known = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")
    )
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = stored(
        texts(docs).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")),
        "labelled",
    )
    n, positive = rows.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < n:
        return None

    def shares(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            hashes, text = _features(found)
            pairs = np.unique(np.column_stack([hashes, text.astype(np.uint64)]), axis=0) if len(hashes) else np.empty((0, 2), np.uint64)
            terms, index, total = np.unique(pairs[:, 0], return_inverse=True, return_counts=True)
            toxic = batch.column("toxic").to_numpy()[pairs[:, 1].astype(np.int64)]
            inside = np.bincount(index, toxic, len(terms)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (terms, total, inside)], ["term", "total", "inside"])

    counted = rows.mapInArrow(shares, "term bigint, total bigint, inside bigint").groupBy("term").agg(
        F.sum("total").alias("total"), F.sum("inside").alias("inside")
    )
    share = positive / n
    # how far the toxic texts with a feature are from what its texts let expect
    tie = (F.col("inside") - F.col("total") * share) / F.sqrt(F.col("total") * (share * (1 - share)) + 0.25)
    # a ratio of odds, unlike one of shares, has no upper bound that depends on how many texts are toxic
    inside, total = F.col("inside"), F.col("total")
    odds = (inside + 0.5) / (total - inside + 0.5) * (n - positive - total + inside + 0.5) / (positive - inside + 0.5)
    best = counted.withColumn("tie", tie).where((F.col("total") >= LEAST) & (F.col("tie") > TIE) & (odds > ODDS))
    terms = np.sort(np.array([r["term"] for r in best.orderBy(F.desc("tie"), "term").limit(FEATURES).collect()], np.int64).view(np.uint64))
    if not len(terms):
        return None

    def held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            text, term, many = _counts(found, terms)
            doc, toxic = batch.column("doc_id").to_numpy(), batch.column("toxic").to_numpy()
            every = np.arange(len(found))  # a row for each text, whatever it holds
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[np.append(text, every)]), pa.array(toxic[np.append(text, every)], pa.int32()),
                 pa.array(np.append(term, np.full(len(found), -1))), pa.array(np.append(many, every * 0))],
                ["doc_id", "toxic", "term", "many"],
            )

    found = sorted(map(tuple, rows.mapInArrow(held, "doc_id bigint, toxic int, term bigint, many bigint").collect()))
    doc, toxic, term, many = np.array(found, np.int64).T
    _, first, text = np.unique(doc, return_index=True, return_inverse=True)
    used = term >= 0
    return fit_severity(text[used], term[used], many[used], toxic[first].astype(np.float64), terms)


def _scored(rows: DataFrame, model: Severity | None, schema: str) -> DataFrame:
    """``rows`` with a text, and their severity and P(grade >= 1), (>= 2), (>= 3) as further columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            reach = model.at_least(found) if model else np.zeros((len(found), GRADES - 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(reach.sum(axis=1)), *[pa.array(reach[:, k]) for k in range(GRADES - 1)]],
                ["doc_id", "severity", *[f"p{k}" for k in range(1, GRADES)]],
            )

    return rows.mapInArrow(run, schema)


def severity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, severity, p_mild, p_strong, p_severe, toxic) of every text.

    ``severity`` is the expected grade, 0 to 3, ``p_*`` the probabilities of at least that grade; ``toxic`` is 1 where at
    least the lowest grade has a probability of 0.3 or more (`REJECT`). Null or blank text: as one without any word. Labels of one kind only or
    none, or that no feature is tied to: all 0. Of several labels of a document the highest holds. Rows without doc_id are left out; repeated rows each
    come out. Empty table: no rows. Further columns don't matter.
    """
    scored = _scored(texts(docs), train(docs, labels, sample), "doc_id bigint, severity double, p1 double, p2 double, p3 double")
    return scored.select(
        "doc_id", "severity", F.col("p1").alias("p_mild"), F.col("p2").alias("p_strong"), F.col("p3").alias("p_severe"),
        (F.col("p1") >= REJECT).cast("int").alias("toxic"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows of ``docs`` whose text isn't toxic, as they are; rows without doc_id are judged too."""
    model = train(docs, labels, sample)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            keep = model.at_least(found)[:, 0] < REJECT if model else np.ones(len(found), bool)
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
