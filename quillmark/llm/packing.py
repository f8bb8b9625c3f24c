"""Packing of token sequences by exact complements.

Pieces of one length are interchangeable, so the plan is made from the number of pieces of each length, at most
``capacity`` numbers whatever the input. Gaps are looked up among the sums of one, two and three available lengths and
filled exactly as long as the counts allow; what is left over goes by best fit. Pieces then find their place by their
rank among those of their length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.textops import pieces, texts
from quillmark.session import stored

CAPACITY = 2048
#: Words whose ids a task keeps at most.
KEPT_WORDS = 1_000_000

#: An invisible separator that stands between words that are looked up at once.
_MARK = "\u2063"

#: How the vocabulary splits words, where runs of letters and of signs and single digits can be looked up by themselves.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLIT = {
    "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed",
    "invert": True,
}
_SUFFIX = "</w>"
_SPACE, _LETTER, _DIGIT, _SIGN, _ODD, _WHOLE = range(6)
#: Kinds of bytes. The lead byte of the letters from U+00C0 to U+00FF counts as a letter, what follows it is looked at apart. Quotes
#: may begin a contraction, and "<" a special token.
_KIND = np.full(256, _ODD, np.uint8)
_KIND[0x21:0x7F] = _SIGN
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = _SPACE
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), 0xC3]] = _LETTER
_KIND[0x30:0x3A] = _DIGIT
_KIND[[0x27, 0x3C]] = _ODD


def _units(found: list[bytes], parts: bool) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray]:
    """What is looked up of some texts, in order: its bytes, whether it is a whole word, and the place of each text's end.

    A text's end is a unit of its own, a line feed. With ``parts`` words of ASCII and U+00C0 to U+00FF are lower-cased and cut into
    runs of letters, digits and runs of signs; words that hold anything else are units as they are.
    """
    joined = b"\n".join(found) + b"\n"
    buf = np.frombuffer(joined, np.uint8).copy()
    kind = np.frombuffer(joined.translate(_KIND.tobytes()), np.uint8).copy()
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in found), np.int64, len(found))) - 1
    latin = np.flatnonzero(buf == 0xC3) + 1
    latin = latin[(buf[latin] != 0x97) & (buf[latin] != 0xB7)]  # the signs of times and division
    kind[latin] = _LETTER
    keep = kind != _SPACE
    edge = np.flatnonzero(np.diff(keep.view(np.int8), prepend=np.int8(0)))
    starts, stops = edge[::2], edge[1::2]
    whole = np.full(len(starts), not parts)
    whole[np.searchsorted(starts, np.flatnonzero(kind == _ODD), "right") - 1] = True
    if whole.any():
        inside = np.zeros(len(buf), np.int8)
        inside[starts[whole]] = 1
        inside[stops[whole]] = -1
        kind[np.cumsum(inside, dtype=np.int8).view(bool)] = _WHOLE
    buf[(buf >= 0x41) & (buf <= 0x5A) & (kind == _LETTER)] += 0x20
    buf[latin[(buf[latin] <= 0x9E) & (kind[latin] == _LETTER)]] += 0x20
    first = np.ones(len(buf), bool)
    first[1:] = kind[1:] != kind[:-1]
    first = (first | (kind == _DIGIT)) & keep
    first[ends] = keep[ends] = True
    place = np.flatnonzero(first)
    data = buf[keep]
    offsets = np.append(np.flatnonzero(first[keep]), len(data)).astype(np.int32)
    units = pa.BinaryArray.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return units, kind[place] == _WHOLE, np.searchsorted(place, ends)


class WordIds:
    """Token ids of texts by words and parts of words: the vocabulary never joins what ASCII white space separates."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        #: The mark's one id, which no text without the mark has; None if the vocabulary has no such id.
        self.mark = mark[0] if len(mark) == 1 else None
        #: The same model for parts of words; None if the vocabulary splits words in another way.
        self.parts = self._parts(path)
        self.clear()

    def _parts(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        setup = json.loads(self.tokenizer.to_str())
        model, split = setup["model"], setup["pre_tokenizer"] or {}
        alphabet = pre_tokenizers.ByteLevel.alphabet()
        if (
            model["type"] != "BPE" or model["end_of_word_suffix"] != _SUFFIX or model["dropout"] or model["ignore_merges"]
            or model["continuing_subword_prefix"] or setup["normalizer"] != _NORMALIZER
            or [x if x["type"] == "Split" else x["type"] for x in split.get("pretokenizers", [])] != [_SPLIT, "ByteLevel"]
            or split["pretokenizers"][1] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
            or not all(c in model["vocab"] and c + _SUFFIX in model["vocab"] for c in alphabet)
            or not all(x["content"].startswith("<") for x in setup["added_tokens"])
        ):
            return None
        parts = Tokenizer.from_file(path)
        parts.normalizer = None
        parts.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        #: Of each id, whether a part ends with it.
        self.closing = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.closing[[i for token, i in model["vocab"].items() if token.endswith(_SUFFIX)]] = True
        return parts

    def clear(self) -> None:
        self.known = {b"\n": 0}  # no word; stands for the id that ends a text
        self.flat, self.at, self.size = np.zeros(1, np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _encode_parts(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts of words, and how many each has."""
        sizes, flat = [], []
        for a in range(0, len(parts), 4000):
            text = b" ".join(parts[a : a + 4000]).decode("utf-8")
            ids = np.array(self.parts.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            sizes.append(np.diff(np.flatnonzero(self.closing[ids]), prepend=-1))
            flat.append(ids)
        return np.concatenate([np.empty(0, np.int64), *sizes]), np.concatenate([np.empty(0, np.uint32), *flat])

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that don't hold the mark, and how many each has: many at once, the mark between them."""
        sizes, flat = [], []
        for a in range(0, len(words), 2000):
            text = f" {_MARK} ".join(w.decode("utf-8") for w in words[a : a + 2000])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            marks = np.flatnonzero(ids == self.mark)
            sizes.append(np.diff(np.concatenate([[-1], marks, [len(ids)]])) - 1)
            flat.append(ids[ids != self.mark])
        return np.concatenate([np.empty(0, np.int64), *sizes]), np.concatenate([np.empty(0, np.uint32), *flat])

    def learn(self, parts: list[bytes], words: list[bytes]) -> None:
        """Take in parts of words and whole words that aren't known."""
        mark = _MARK.encode("utf-8")
        plain = [w for w in words if mark not in w] if self.mark is not None else []
        odd = [w for w in words if mark in w] if self.mark is not None else words
        each = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode("utf-8") for w in odd], add_special_tokens=False)]
        sizes, flats = zip(
            self._encode_parts(parts), self._encode(plain),
            (np.fromiter(map(len, each), np.int64, len(each)), np.fromiter(chain.from_iterable(each), np.uint32)),
        )
        size = np.concatenate(sizes)
        self.known.update(zip(chain(parts, plain, odd), range(len(self.at), len(self.at) + len(size))))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *flats])

    def __call__(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with its last 0, and where each text ends."""
        units, whole, last = _units(found, self.parts is not None)
        coded = units.dictionary_encode()
        kind, (_, offsets, data) = coded.indices.to_numpy(), coded.dictionary.buffers()
        cuts, data = np.frombuffer(offsets, np.int32)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes()
        distinct = [data[a:b] for a, b in zip(cuts, cuts[1:])]
        if len(self.known) > KEPT_WORDS:
            self.clear()
        at = list(map(self.known.get, distinct))
        new = [i for i, place in enumerate(at) if place is None]
        if new:
            is_word = np.zeros(len(distinct), bool)
            is_word[kind] = whole
            self.learn([distinct[i] for i in new if not is_word[i]], [distinct[i] for i in new if is_word[i]])
            for i in new:
                at[i] = self.known[distinct[i]]
        index = np.array(at, np.int64)[kind]
        size = self.size[index]
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[index] - ends + size, size)]
        return ids, ends[last]


@lru_cache(maxsize=1)
def _word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and a last 0, cut only where longer than ``capacity``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = _word_ids(public_tokenizers.path(vocabulary))
        for batch, found in pieces(batches):
            ids, ends = encode(found)
            rows, a = [], 0
            for doc, b in zip(batch.column("doc_id").to_pylist(), ends.tolist()):
                for n, at in enumerate(range(a, b, capacity)):
                    part = ids[at : min(at + capacity, b)]
                    rows.append((doc, n, at - a, len(part), zlib.crc32(part)))
                a = b
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return texts(docs).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Stock:
    """How many pieces of each length are left."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.left[gap] else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """Two lengths that sum to ``gap``, the most unlike ones."""
        if gap < 2:
            return None
        low = np.arange(1, gap // 2 + 1)
        high = gap - low
        good = (self.left[low] > 0) & (self.left[high] > 0) & ((low != high) | (self.left[low] > 1))
        at = np.argmax(good)
        return (int(high[at]), int(low[at])) if good[at] else None

    def triple(self, gap: int) -> tuple[int, ...] | None:
        for first in np.flatnonzero(self.left[: max(0, gap - 1)])[::-1].tolist():
            if 3 * first < gap:
                return None
            self.left[first] -= 1
            rest = self.pair(gap - first)
            self.left[first] += 1
            if rest:
                return (first, *rest)
        return None

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often this combination can be taken."""
        kinds, uses = np.unique(lengths, return_counts=True)
        return int((self.left[kinds] // uses).min())

    def take(self, lengths: tuple[int, ...], n: int) -> None:
        for length in lengths:
            self.left[length] -= n


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, number of sequences that hold pieces of these lengths), for so many pieces of each length.

    Exact complements can use up small pieces that best fit would need later; so plans with singles, pairs and triples, without
    triples, without pairs, and by best fit alone are made from the same counts, and the one with the fewest sequences is taken.
    """
    plans = [_plan(counts, capacity, kinds) for kinds in (3, 2, 1, 0)]
    return min(plans, key=lambda plan: sum(n for _, n in plan))


def _plan(counts: dict[int, int], capacity: int, kinds: int) -> list[tuple[tuple[int, ...], int]]:
    """Gaps filled exactly by up to ``kinds`` pieces, the largest pieces' gaps first; what is left by best fit."""
    stock, plan = _Stock(counts, capacity), []
    for find in (stock.single, stock.pair, stock.triple)[:kinds]:
        for length in range(capacity, 0, -1):
            while stock.left[length]:
                stock.left[length] -= 1
                rest = () if length == capacity else find(capacity - length)
                stock.left[length] += 1
                if rest is None:
                    break
                n = stock.times((length, *rest))
                if not n:
                    break
                stock.take((length, *rest), n)
                plan.append(((length, *rest), n))
    by_gap: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        n = int(stock.left[length])
        for gap in range(length, capacity):
            while n and by_gap.get(gap):
                lengths, many = by_gap[gap].pop()
                each = min(gap // length, n)
                filled = min(many, n // each)
                n -= filled * each
                by_gap.setdefault(gap - each * length, []).append((lengths + (length,) * each, filled))
                if many > filled:
                    by_gap[gap].append((lengths, many - filled))
            if not n:
                break
        each = capacity // length
        for size, many in ((each, n // each), (n % each, 1)):
            if size and many:
                by_gap.setdefault(capacity - size * length, []).append(((length,) * size, many))
    return plan + [x for group in by_gap.values() for x in group]


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, sequence of that rank, offset), by length and rank: where pieces of a length go."""
    rows, used, sequence = [], {}, 0
    for lengths, n in plan:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place in a sequence.

    Sequences hold at most ``capacity`` ids, and pieces lie in them without gaps from 0 on. A null or empty text is the
    last 0 alone. Rows without doc_id are left out; repeated rows are packed each by itself. Empty table: no rows.
    Further columns of ``docs`` don't matter. The plan has a few entries for each length, so it can go to every task.
    """
    found = stored(token_pieces(docs, vocabulary, capacity).withColumn("part", F.spark_partition_id()), "pieces")
    by_part = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = found.sparkSession.sparkContext.broadcast(_slots(packing_plan(counts, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = found.withColumn("inside", F.row_number().over(inside) - 1).join(base, ["part", "length"])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = slots.value
        keys = (table[:, 0] << 48) | table[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) | rank, "right") - 1
            own = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
            yield pa.RecordBatch.from_arrays(
                [*own.columns, pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])],
                [*own.schema.names, "sequence_id", "offset"],
            )

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("inside")).alias("rank")).mapInArrow(
        place,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
