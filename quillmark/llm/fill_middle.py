"""Fill-in-the-middle training texts: whole texts cut at two unit borders and put in another order.

Cuts are found on whole words of memory: a text's UTF-8 bytes are viewed as 64-bit words, the bytes that end a unit are marked
by arithmetic on all eight bytes of a word at once, marks are counted word by word, the word that holds the wanted mark is
found in the running count, and the place inside the word by comparing its bytes' running counts, again eight at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.textops import pieces

UNITS = ("line", "character")
_U = np.uint64
_EACH = _U(0x0101010101010101)
_LOW, _HIGH = _U(0x7F) * _EACH, _U(0x80) * _EACH


@dataclass(frozen=True)
class Plan:
    """How texts are cut: seed, per cent of texts that are rearranged and of those that start with the suffix, marks, unit."""

    seed: int = 7
    rearranged: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    unit: str = "line"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        inside = {c for m in marks for c in m[1:]}
        if not all(marks) or len(set(marks)) < 3 or any(m[0] in inside for m in marks):
            # else a mark could arise where a text and a mark meet
            raise ValueError(f"marks must be unlike, and begin with a character that none has inside: {marks}")
        if any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError(f"no mark may begin with another: {marks}")
        if self.unit not in UNITS:
            raise ValueError(f"unit must be one of {UNITS}, not {self.unit!r}")


def _equal(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals ``byte``."""
    x = words ^ (_U(byte) * _EACH)
    return ~(((x & _LOW) + _LOW) | x | _LOW)


def _first_bytes(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that begins a character."""
    return _HIGH & ~(words & ~(words << _U(1)))


class _Marked:
    """Some texts, each from a word border on, with the ends of their units and the starts of their characters marked."""

    def __init__(self, found: list[bytes], unit: str):
        self.sizes = np.fromiter(map(len, found), np.int64, len(found))
        pads = -self.sizes % 8
        joined = b"".join(x for text, pad in zip(found, pads) for x in (text, b"\0" * pad)) + b"\0" * 8
        words = np.frombuffer(joined, "<u8").astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum((self.sizes + pads) // 8)])
        starts = _first_bytes(words)
        if unit == "line":
            marks = _equal(words, 10)
        else:  # a character ends before the next one starts
            marks = (starts >> _U(8)) | np.append(starts[1:] << _U(56), _U(0))
        filled = np.flatnonzero(self.sizes)
        last = self.first[1:][filled] - 1
        place = ((self.sizes[filled] - 1) % 8 * 8).astype(np.uint64)
        marks[last] &= (_U(0xFF) << place) | ((_U(1) << place) - _U(1))  # nothing ends in the padding
        marks[last] |= _U(0x80) << place  # the end of the text ends its last unit
        self.marks, self.ends = marks, self._running(marks)
        self.starts, self.points = starts, self._running(starts)
        self.units = self.ends[self.first[1:]] - self.ends[self.first[:-1]]

    @staticmethod
    def _running(marks: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.bitwise_count(marks), dtype=np.int64)])

    def end_of(self, unit: np.ndarray) -> np.ndarray:
        """Bytes of each text up to the end of its unit of that number, from 1; 0 for number 0."""
        begin = self.first[:-1]
        wanted = self.ends[begin] + unit
        word = np.maximum(np.searchsorted(self.ends, wanted, "left") - 1, 0)
        rank = (wanted - self.ends[word]).astype(np.uint64)
        upto = (self.marks[word] >> _U(7)) * _EACH  # each byte: marks in the word up to it
        reached = ((upto | _HIGH) - rank * _EACH) & _HIGH
        place = word * 8 + 9 - np.bitwise_count(reached)
        return np.where(unit > 0, place - 8 * begin, 0)

    def characters(self, size: np.ndarray) -> np.ndarray:
        """Characters in the first ``size`` bytes of each text."""
        begin = self.first[:-1]
        word, part = begin + size // 8, (size % 8 * 8).astype(np.uint64)
        inside = np.bitwise_count(self.starts[word] & ((_U(1) << part) - _U(1)))
        return self.points[word] + inside - self.points[begin]


def _cuts(plan: Plan) -> Column:
    @F.arrow_udf("struct<n:bigint,before:bigint,between:bigint>")
    def cut(text: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        n, before, between = [], [], []
        batch = pa.RecordBatch.from_arrays([text, one, two], ["text", "one", "two"])
        for part, found in pieces([batch]):
            marked = _Marked(found, plan.unit)
            a, b = (part.column(c).to_numpy(zero_copy_only=False) % (marked.units + 1) for c in ("one", "two"))
            start = marked.characters(marked.end_of(np.minimum(a, b)))
            n.append(marked.units)
            before.append(start)
            between.append(marked.characters(marked.end_of(np.maximum(a, b))) - start)
        arrays = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (n, before, between)]
        return pa.StructArray.from_arrays(arrays, ["n", "before", "between"])

    return cut


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every text, in an order in which a model learns to fill a gap.

    ``n`` units (lines with their line break, or characters); prefix, middle and suffix are stretches of whole units, cut at two
    borders that follow from the seed and ``doc_id`` alone, so every run and every cluster cuts alike. ``form``: ``psm`` (prefix,
    suffix, middle), ``spm`` (suffix, prefix, middle), or ``plain``: the text as it is, with no cuts (NULL), where it is empty, holds
    one of the marks, or isn't to be rearranged. A null text is empty; a null doc_id counts as an empty one. One row for each row,
    repeated ones too. An empty table gives none. Further columns don't matter.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    key = F.concat(F.lit(f"{plan.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    hashed = own.withColumn("h", F.sha2(key, 256))

    def draw(i: int) -> Column:
        return F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("bigint")

    held = F.lit(False)
    for mark in (plan.prefix, plan.suffix, plan.middle):
        held = held | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | held | (draw(2) % 100 >= plan.rearranged)
    form = F.when(plain, "plain").when(draw(3) % 100 < plan.suffix_first, "spm").otherwise("psm")
    cut = hashed.select("doc_id", "text", form.alias("form"), _cuts(plan)("text", draw(0), draw(1)).alias("cut"))
    start, size = F.col("cut.before"), F.col("cut.between")
    prefix = F.substring("text", F.lit(1), start)
    middle = F.substring("text", start + 1, size)
    suffix = F.substring("text", start + size + 1, F.length("text"))
    p, s, m = F.lit(plan.prefix), F.lit(plan.suffix), F.lit(plan.middle)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.concat(p, prefix, s, suffix, m, middle))
    )
    cuts_shown = F.col("form") != "plain"
    return cut.select(
        "doc_id", F.col("cut.n").alias("n"), "form", F.when(cuts_shown, start).alias("prefix_chars"),
        F.when(cuts_shown, size).alias("middle_chars"), output.alias("output"),
    )


def restored(output: Column | str, form: Column | str, plan: Plan = Plan()) -> Column:
    """The text again, from what `fill_in_middle` made of it and its form; NULL where that holds no marks."""
    output, form = (F.col(x) if isinstance(x, str) else x for x in (output, form))

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        # no text that was rearranged holds a mark, so the first ones found are those put in
        a = F.lit(len(first) + 1)
        at = F.locate(second, output)
        end = F.locate(plan.middle, output)
        return (
            F.substring(output, a, at - a),
            F.substring(output, at + len(second), end - at - len(second)),
            F.substring(output, end + len(plan.middle), F.length(output)),
        )

    prefix, suffix, middle = parts(plan.prefix, plan.suffix)
    suffix2, prefix2, middle2 = parts(plan.suffix, plan.prefix)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .when(form == "spm", F.concat(prefix2, middle2, suffix2))
    )
