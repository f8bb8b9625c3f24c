"""Phrases whose words belong together, counted on a prefix-free parse of all texts.

Every text's words are cut into chunks wherever two successive words have a hash that is a multiple of `EVERY`, so equal
passages are cut alike wherever they stand. A chunk runs on over the two words that start the next one; so every phrase of up to
three words lies whole in the chunk where it begins, and is counted there and nowhere else. Unlike chunks form a dictionary with
their frequencies; phrases are counted in each chunk of the dictionary once, weighted by its frequency.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.textops import _LOWER, mix, pieces, rolling, stretch
from quillmark.operators.spread import attach
from quillmark.session import stored

#: Words of a phrase at most; a chunk's overlap is one less.
LONGEST = 3
#: Words of a chunk, about.
EVERY = 24
#: Bytes of chunks, weighted phrases, and unlike phrases that a task gathers before it sends them on.
CHUNK_BYTES, PACK, HELD = 24 << 20, 2_000_000, 700_000
#: Phrases of one bucket, about, when they are weighed and counted, and the bits of its table (a power of two): the only thing sent to every task.
BUCKET, TABLE_BITS = 2_000_000, 27
#: Parts of a language among which its first phrases are looked for.
PARTS = 64

_U = np.uint64
_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_ROLE = np.random.default_rng(29).integers(0, 1 << 64, LONGEST + 1, dtype=np.uint64) | _U(1)
_CHUNKS = "lang string, overlap int, chunk string, n_words bigint, n bigint"
_PHRASES = "lang string, size int, phrase string, f bigint"


class _Stream:
    """Words of some texts as one byte string: lower case, a blank between two words, a line break between two pieces or texts."""

    def __init__(self, found: list[bytes]):
        raw = _LOWER[np.frombuffer(b"\n".join(found) + b"\n", np.uint8)]
        gap = _GAP[raw]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1)))
        starts, ends = edge[::2], edge[1::2]
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
        text_ends = np.cumsum(np.fromiter((len(x) + 1 for x in found), np.int64, len(found)))
        following = np.append(starts[1:], len(raw))
        #: whether a word is the last one of its piece
        self.last = breaks[following] > breaks[ends]
        keep = ~gap
        keep[ends] = True  # one byte after each word, whatever the gap
        raw[ends] = np.where(self.last, 10, 32)
        self.data = raw[keep].tobytes()
        self.ends = np.flatnonzero(_GAP[raw[keep]])
        self.starts = np.append(0, self.ends[:-1] + 1)[: len(self.ends)]
        #: the first word of every text, and the number of all words
        self.first = np.searchsorted(starts, np.append(0, text_ends))
        buf = raw[keep]
        self.hash = stretch(rolling(buf), self.starts, self.ends) if len(buf) else np.empty(0, np.uint64)

    def __len__(self) -> int:
        return len(self.starts)

    def borders(self) -> np.ndarray:
        """Words that begin a chunk: where this word and the next one trigger, and the first one of each text."""
        n = len(self)
        pair = mix(self.hash[:-1] * _ROLE[0] + self.hash[1:] * _ROLE[1] + self.last[:-1].astype(np.uint64)) if n else self.hash
        return np.union1d(np.flatnonzero(pair % _U(EVERY) == 0), self.first[:-1][self.first[:-1] < n])

    def phrases(self, size: int, seed: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, places) of phrases of that size which lie in one piece and start where ``begins``; ``seed``: one for each word."""
        n = max(len(self) - size + 1, 0)
        good = begins[:n].copy()
        total = seed[:n] + _U(size)
        for j in range(size):
            total = total + self.hash[j : j + n] * _ROLE[j]
            if j < size - 1:
                good &= ~self.last[j : j + n]
        at = np.flatnonzero(good)
        return mix(total[at]), at


def _languages(batch: pa.RecordBatch) -> list[str]:
    return pc.fill_null(batch.column("lang"), "und").to_pylist()


def _chunked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's dictionary of chunks."""
    held: dict[tuple, list[int]] = {}
    size = 0

    def sent() -> pa.RecordBatch:
        langs, overlaps, chunks = zip(*held) if held else ((), (), ())
        words, counts = zip(*held.values()) if held else ((), ())
        text = pa.array(chunks, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(overlaps, pa.int32()), text, pa.array(words, pa.int64()), pa.array(counts, pa.int64())],
            ["lang", "overlap", "chunk", "n_words", "n"],
        )

    for batch, found in pieces(batches):
        stream = _Stream(found)
        borders = stream.borders()
        if not len(borders):
            continue
        text = np.searchsorted(stream.first, borders, "right") - 1
        text_end = stream.first[text + 1]
        upto = np.append(borders[1:], len(stream))
        tail = np.where(upto < text_end, LONGEST - 1, 0)  # the next chunk's first words, within the text
        tail = np.minimum(tail, text_end - upto)
        begin, end = stream.starts[borders], stream.ends[upto + tail - 1]
        langs = _languages(batch)
        for t, a, b, over, words in zip(text.tolist(), begin.tolist(), end.tolist(), tail.tolist(), (upto - borders).tolist()):
            key = (langs[t], over, stream.data[a:b])
            entry = held.get(key)
            if entry is None:
                held[key] = [words, 1]
                size += b - a + 150
            else:
                entry[1] += 1
        if size > CHUNK_BYTES:
            yield sent()
            held, size = {}, 0
    yield sent()


def chunks(docs: DataFrame) -> DataFrame:
    """(lang, overlap, chunk, n_words, n): the dictionary of the parse. ``overlap`` words at the end also begin another chunk."""
    own = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    each = own.mapInArrow(_chunked, _CHUNKS)
    return each.groupBy("lang", "overlap", "chunk").agg(F.first("n_words").alias("n_words"), F.sum("n").alias("n"))


class _Entries:
    """Some entries of the dictionary: their words, and for each word its language's seed, its weight, whether it counts as a start."""

    def __init__(self, batch: pa.RecordBatch, found: list[bytes]):
        self.stream = stream = _Stream(found)
        self.langs = _languages(batch)
        weights = batch.column("n").to_numpy()
        overlaps = batch.column("overlap").to_numpy()
        names = {x: np.frombuffer(x.encode() + b"\0" * 8, np.uint8) for x in set(self.langs)}
        seeds = {x: stretch(rolling(y), np.array([0]), np.array([len(y)]))[0] for x, y in names.items()}
        words = np.diff(stream.first)
        self.entry = np.repeat(np.arange(len(words)), words)
        self.seed = np.repeat(np.array([seeds[x] for x in self.langs], np.uint64), words)
        self.weight = np.repeat(weights, words)
        self.begins = np.arange(len(stream)) < np.repeat(stream.first[1:] - overlaps, words)


def _encoded(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit values and small counts, byte by byte: steps between values are small, so upper bytes repeat."""
    steps = np.diff(hashes, prepend=np.uint32(0)).astype("<u4")
    return steps.view(np.uint8).reshape(-1, 4).T.tobytes() + counts.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes()


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 6
    planes = np.frombuffer(data, np.uint8)
    steps = np.ascontiguousarray(planes[: 4 * n].reshape(4, n).T).view("<u4").reshape(-1)
    counts = np.ascontiguousarray(planes[4 * n :].reshape(2, n).T).view("<u2").reshape(-1)
    return np.cumsum(steps, dtype=np.uint32), counts.astype(np.int64)


def _weigher(bucket_bits: int, enough: int):
    """Packs a task's phrases, by the leading bits of their hashes, with how often they occur (as far as ``enough``)."""

    def sent(hashes: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(hashes) >> _U(32 - bucket_bits)  # bucket, then 32 bits
        weight = np.concatenate(weights)
        order = np.argsort(every)
        every, weight = every[order], weight[order]
        starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        count = np.minimum(np.add.reduceat(weight, starts), enough)
        every = every[starts]
        bucket = every >> _U(32)
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        rows = [(int(bucket[a]), _encoded(every[a:b].astype(np.uint32), count[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.RecordBatch.from_pydict({"bucket": pa.array([r[0] for r in rows], pa.int32()), "data": pa.array([r[1] for r in rows], pa.binary())})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, weights, held = [], [], 0
        for batch, found in pieces(_as_texts(batches)):
            entries = _Entries(batch, found)
            for size in range(1, LONGEST + 1):
                hashed, at = entries.stream.phrases(size, entries.seed, entries.begins)
                hashes.append(hashed)
                weights.append(np.minimum(entries.weight[at], enough))
                held += len(hashed)
            if held >= PACK:
                yield sent(hashes, weights)
                hashes, weights, held = [], [], 0
        if held:
            yield sent(hashes, weights)

    return run


def _as_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.rename_columns(["text" if c == "chunk" else c for c in batch.schema.names])


def _bucket_bits(n_words: int) -> int:
    """Bits of the number of buckets; it follows the data."""
    return min(max(6, (LONGEST * n_words // BUCKET).bit_length()), TABLE_BITS - 3)


def _table(dictionary: DataFrame, n_words: int, enough: int) -> np.ndarray:
    """Bits, by the leading bits of a phrase's hash: may it occur ``enough`` times?

    A bit is set for every phrase that does, and for one that shares 32 bits beyond its bucket's or its bit with another: the table
    has a fixed size, so the more there is to know, the less it weeds out. What it lets through is counted exactly.
    """
    bucket_bits = _bucket_bits(n_words)
    packs = dictionary.mapInArrow(_weigher(bucket_bits, enough), "bucket int, data binary")
    shift = 32 + bucket_bits - TABLE_BITS

    def weigh(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [_decoded(x.as_py()) for x in table.column("data")]
        hashes = np.concatenate([x[0] for x in parts])
        counts = np.concatenate([x[1] for x in parts])
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        frequent = hashes[starts[np.add.reduceat(counts, starts) >= enough]].astype(np.uint64)
        bits = np.zeros(1 << (TABLE_BITS - bucket_bits), bool)
        bits[(frequent >> _U(shift)).astype(np.int64)] = True
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    out = np.zeros(1 << (TABLE_BITS - 3), np.uint8)
    width = 1 << (TABLE_BITS - 3 - bucket_bits)
    # all rows together are as large as the table
    for row in packs.groupBy("bucket").applyInArrow(weigh, "bucket int, bits binary").toLocalIterator():
        out[row["bucket"] * width : (row["bucket"] + 1) * width] = np.frombuffer(row["bits"], np.uint8)
    return out


def _counter(table, buckets: int):
    """Counts, as text, the phrases of a task's entries that ``table`` lets through; packed by bucket, a language before each phrase."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def sent() -> pa.RecordBatch:
            keys, counts = list(held), np.fromiter(held.values(), np.int64, len(held))
            bucket = np.fromiter(map(crc32, keys), np.int64, len(keys)) % buckets
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            cuts = pa.array(np.append(starts, len(bucket)), pa.int32())
            phrases = pa.array(keys, pa.binary()).take(pa.array(order))
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[starts], pa.int32()), pa.ListArray.from_arrays(cuts, phrases), pa.ListArray.from_arrays(cuts, pa.array(counts[order]))],
                ["bucket", "phrases", "counts"],
            )

        bits = table.value
        for batch, found in pieces(_as_texts(batches)):
            entries = _Entries(batch, found)
            stream = entries.stream
            names = [x.encode() + b"\n" for x in entries.langs]
            for size in range(1, LONGEST + 1):
                hashed, at = stream.phrases(size, entries.seed, entries.begins)
                key = (hashed >> _U(64 - TABLE_BITS)).astype(np.int64)
                at = at[(bits[key >> 3] >> (7 - (key & 7)).astype(np.uint8)) & 1 == 1]
                begin, end = stream.starts[at].tolist(), stream.ends[at + size - 1].tolist()
                for e, a, b, w in zip(entries.entry[at].tolist(), begin, end, entries.weight[at].tolist()):
                    key = names[e] + stream.data[a:b]
                    held[key] = held.get(key, 0) + w
            if len(held) > HELD:
                yield sent()
                held = {}
        if held:
            yield sent()

    return run


def _summed(enough: int):
    """The phrases of a bucket that occur often enough, with how often."""

    def run(table: pa.Table) -> pa.Table:
        flat = pa.table({c: pc.list_flatten(table.column(c).combine_chunks()) for c in ("phrases", "counts")})
        total = flat.group_by("phrases").aggregate([("counts", "sum")])
        total = total.filter(pc.greater_equal(total.column("counts_sum"), enough))
        names, phrases = [], []
        for key in total.column("phrases").to_pylist():
            name, _, phrase = key.rpartition(b"\n")
            names.append(name.decode())
            phrases.append(phrase.decode())
        sizes = [x.count(" ") + 1 for x in phrases]
        return pa.table({
            "lang": pa.array(names, pa.string()), "size": pa.array(sizes, pa.int32()), "phrase": pa.array(phrases, pa.string()),
            "f": total.column("counts_sum").cast(pa.int64()),
        })

    return run


def phrase_counts(dictionary: DataFrame, enough: int) -> DataFrame:
    """(lang, size, phrase, f) of all phrases of one to three words that occur at least ``enough`` times."""
    n_words = dictionary.agg(F.sum("n_words")).first()[0] or 0
    table = dictionary.sparkSession.sparkContext.broadcast(_table(dictionary, n_words, enough))
    packs = dictionary.mapInArrow(_counter(table, 1 << _bucket_bits(n_words)), "bucket int, phrases array<binary>, counts array<bigint>")
    return packs.groupBy("bucket").applyInArrow(_summed(enough), _PHRASES)


@dataclass(frozen=True)
class Settings:
    """Least occurrences (up to 65,535), share in per cent of a longer phrase that takes its parts' place, phrases of a language."""

    enough: int = 10
    inside: int = 50
    first: int = 2000


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exactly: products of counts up to 10**15 have 38 digits."""
    a, left, right = (x.cast("decimal(15,0)") for x in (a, left, right))
    million = F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", million * a * a, left * right)


def scored_phrases(counts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the candidates among `phrase_counts` that no longer one stands for."""
    key = F.concat_ws("\n", "lang", "phrase").alias("key")  # a phrase holds no line break
    known = stored(counts.select(F.col("lang"), "size", "phrase", "f", key), "phrases")
    candidates = known.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.split("phrase", " ").alias("w"))

    def words(first: int, last: Column) -> Column:
        return F.concat_ws(" ", F.slice("w", first, last))

    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = candidates.select("lang", "phrase", "a", "size", "w", k).select(
        "lang", "phrase", "a", "k", F.concat_ws("\n", "lang", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k")))).alias("head"),
        F.concat_ws("\n", "lang", F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")))).alias("tail"),
    )
    heads = attach(stored(cuts, "cuts"), known.select(F.col("key").alias("head"), F.col("f").alias("l")), "head", how="inner")
    both = attach(stored(heads, "cuts"), known.select(F.col("key").alias("tail"), F.col("f").alias("r")), "tail", how="inner")
    cut = F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    best = both.groupBy("lang", "phrase", "a").agg(F.min(cut).alias("cut"))
    # what a longer candidate holds, all shorter phrases of two words and more
    sub = F.explode(
        F.flatten(
            F.transform(
                F.sequence(F.lit(2), F.col("size") - 1),
                lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.concat_ws(" ", F.slice("w", i, m))),
            )
        )
    )
    longer = candidates.where("size > 2").select("lang", sub.alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < settings.inside * F.col("a"))
    )
    return kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases whose words attract each other most.

    Words are runs without blank or tab, A-Z in lower case, of pieces that end at ``. , ; : ! ?`` or a line break. Of a phrase of two or
    three words, ``a`` counts all occurrences inside pieces, ``l`` and ``r`` those of the two parts of its weakest cut, ``n`` the words of
    the language; ``score`` is a million times a a / (l r), rounded down. A phrase is left out if a longer one that holds it occurs
    half as often. A null language is ``und``, a null text has no words. Rows need no id, and repeated ones count each. Languages
    without such phrases, and an empty table, give no rows. Further columns don't matter.
    """
    dictionary = stored(chunks(docs), "chunks")
    sizes = dictionary.groupBy("lang").agg(F.sum(F.col("n_words") * F.col("n")).alias("n"))
    scored = stored(scored_phrases(phrase_counts(dictionary, settings.enough), settings), "scored")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    # the first of each part, then the first of those: no task ranks a whole language
    near = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    near = near.where(F.col("rank") <= settings.first).drop("part", "rank")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    # one row for each language
    return ranked.where(F.col("rank") <= settings.first).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
