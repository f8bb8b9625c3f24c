"""Exact Jaccard self-join of texts on word n-grams, by prefixes of tokens and of token combinations.

A token is a distinct n-gram. Tokens are ordered: those of one document first, then rare ones, then frequent ones, each
by hash. Two similar sets share a token within their prefixes. A rare first common token is found by the tokens
themselves. Where the first common token is frequent all common tokens are, so that both prefixes, made longer by one
token for each token class, share two tokens of one class: those documents are found by pairs of tokens of a class.
Candidates are then compared in full.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm import echoes
from quillmark.llm.graph import components
from quillmark.llm.textops import Words, mix, pieces, texts
from quillmark.session import stored

#: From so many documents on a token is frequent.
FREQUENT = 16
#: About so many documents of a list are compared with the whole list in the first turn; each turn has twice as many.
MOST_PIVOTS = 32
#: Documents of a list that a document is compared with at once, about.
LIST_CHUNK = 512
#: Turns at most in which a list's documents are compared with a single one.
STAR_TURNS = 5
#: Ids of copies that are sent to every task at most; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Bytes of a token's hash that are kept beside its bucket.
WIDTH = 5
#: Sizes of similar sets lie in the same or in neighbouring bands; a little more than 1 / 0.8.
_BAND = 1.26


def _token_sets(found: list[bytes], size: int) -> Iterator[np.ndarray]:
    return Words(found, lower=True).shingles(size)


def shingle_sets(docs: DataFrame, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, digest) of every text; equal digests are equal sets. Null or blank text: size 0."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in pieces(batches):
            sets = list(_token_sets(found, size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest"],
            )

    return texts(docs).mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary")


def _least(n: int, percent: int) -> int:
    """Fewest common tokens a set of ``n`` has with any similar one."""
    return -(-percent * n // 100)


def signatures(keys: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """What a set of ``n`` tokens is found by, ascending; ``keys`` are its tokens that other documents hold too.

    With each comes how many tokens can be common to two sets that are first found by it: those from a token on, and all
    frequent ones for a pair of them.
    """
    frequent = keys >= echoes.FREQUENT
    rare, often = np.sort(keys[~frequent]).view(np.uint64), np.sort(keys[frequent]).view(np.uint64)
    room = n - _least(n, percent) + 1 - (n - len(keys))
    if room <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    # a mixed hash, so that the order is not that of the buckets
    rare, often = np.sort(mix(rare)), np.sort(mix(often))
    out = [rare[:room]]
    left = [len(keys) - np.arange(len(out[0]))]
    if room > len(rare) and len(often):
        band = int(np.log(n) / np.log(_BAND))
        for tag in (band, band + 1):
            classes = int(0.1 * _BAND**tag)
            reach = often[: room - len(rare) + classes]
            salt = np.uint64(2 * tag + 1)
            if classes == 0:
                out.append(mix(reach + salt))
                left.append(len(often) - np.arange(len(reach)))
                continue
            kind = reach % np.uint64(classes)
            order = np.argsort(kind, kind="stable")
            reach, kind = reach[order], kind[order]
            step = 1
            while step < len(reach):  # all pairs of a class: it holds about three tokens
                same = kind[step:] == kind[:-step]
                if not same.any():
                    break
                out.append(mix(mix(reach[:-step][same] + salt) + reach[step:][same]))
                left.append(np.full(len(out[-1]), len(often)))
                step += 1
    found, first = np.unique(np.concatenate(out), return_index=True)
    return found.view(np.int64), np.concatenate(left)[first].astype(np.int32)


def _signed(sets: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                signatures(keys.values.to_numpy(), n.as_py(), percent)
                for keys, n in zip(batch.column("keys"), batch.column("size"))
            ]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x, _ in found])]), pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*(x[i] for x in found), np.empty(0, kind)]).astype(kind)))
                for i, kind in enumerate((np.int64, np.int32))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("size"), *lists], ["doc_id", "size", "signature", "common"]
            )

    signed = sets.select("doc_id", "size", "keys").mapInArrow(
        run, "doc_id bigint, size int, signature array<bigint>, common array<int>"
    )
    return signed.select("doc_id", "size", F.inline(F.arrays_zip("signature", "common")))


def _fit(percent: int, of: dict[str, Column] | None = None) -> Column:
    """Whether sizes, and what can be common at most, leave room for enough common tokens."""
    of = of or {c: F.col(c) for c in ("a_size", "b_size", "a_common", "b_common")}
    least, most = F.least(of["a_size"], of["b_size"]), F.greatest(of["a_size"], of["b_size"])
    return (100 * least >= percent * most) & (
        F.least(of["a_common"], of["b_common"]) * (100 + percent) >= percent * (of["a_size"] + of["b_size"])
    )


def _side_columns(side: str) -> list[Column]:
    return [F.col("doc_id").alias(side), F.col("size").alias(f"{side}_size"), F.col("common").alias(f"{side}_common")]


def _ordered(pairs: DataFrame) -> DataFrame:
    """Distinct pairs, the smaller id first."""
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left, right = (
        sets.select(F.col("doc_id").alias(side), F.col("size").alias(f"{side}_size"), F.col("keys").alias(f"{side}_keys")) for side in "ab"
    )
    shared = F.size(F.array_intersect("a_keys", "b_keys"))
    both = pairs.join(right, "b").join(left, "a").select(
        "a", "b", shared.alias("shared"), (F.col("a_size") + F.col("b_size") - shared).alias("of")
    )
    return both.withColumn("linked", 100 * F.col("shared") >= percent * F.col("of"))


def _against_lists(heads: DataFrame, posts: DataFrame, percent: int) -> DataFrame:
    """Pairs of a head and what is in its lists but in another component.

    Lists are cut into chunks by document, so that what a head meets in all its lists comes together chunk by chunk, and
    a pair comes out once however many lists hold it.
    """
    longest = posts.groupBy("signature").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    chunk = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("chunk")), F.lit(1 + longest // LIST_CHUNK))
    lists = posts.groupBy("signature", chunk.alias("chunk")).agg(
        F.collect_list(F.struct(*_side_columns("b"), F.col("component").alias("b_component"))).alias("members")
    )
    heads = heads.select("signature", *_side_columns("a"), F.col("component").alias("a_component"))
    own = {c: F.col(c) for c in ("a_size", "a_common")}
    met = F.filter(
        "members", lambda m: (m["b_component"] != F.col("a_component")) & _fit(percent, {**own, "b_size": m["b_size"], "b_common": m["b_common"]})
    )
    rows = heads.join(lists, "signature").select("a", "chunk", F.transform(met, lambda m: m["b"]).alias("met")).where(F.size("met") > 0)
    return rows.groupBy("a", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("met"))).alias("met")).select("a", F.explode("met").alias("b"))


def ngram_links(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Membership ``(doc_id, n_shingles, class_id)`` and links ``(a, b, shared, of)`` between classes of equal sets.

    Any two similar classes are joined by a path of links; pairs that others connect already aren't all compared.
    """
    membership, links, _ = _linked(docs, size, percent)
    return membership, links


def _linked(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership, links, and the components ``(id, component)`` of the links."""
    members = stored(shingle_sets(docs, size), "sets")
    classes = members.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    membership = members.join(classes, "digest", "left").select(
        "doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id")
    ).distinct()
    total, texts_n = members.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    buckets = echoes.bucket_count(total)
    # tokens are counted over classes: only one text of each goes on
    others = membership.where("doc_id <> class_id").select("doc_id").distinct()
    if texts_n - classes.count() <= BROADCAST_IDS:
        others = F.broadcast(others)
    firsts = texts(docs).join(others, "doc_id", "left_anti")

    def hasher(batch: pa.RecordBatch, found: list[bytes]) -> Iterator[tuple[np.ndarray, int]]:
        for tokens in _token_sets(found, size):
            yield tokens, len(tokens)

    rows = echoes.packed(firsts, hasher, buckets, WIDTH, FREQUENT, copies=False)
    grouped = echoes.settled(rows, WIDTH, FREQUENT).groupBy("doc_id", "size").agg(F.flatten(F.collect_list("keys")).alias("keys"))
    sets = stored(
        grouped.withColumn("common", F.size("keys")).where(F.col("common") * 100 >= percent * F.col("size")), "shared-tokens"
    )
    posts = _signed(sets, percent)
    lists = posts.groupBy("signature").agg(
        F.min(F.struct("doc_id", "size", "common")).alias("pivot"), F.max("doc_id").alias("last")
    ).where("pivot.doc_id < last")
    posts = stored(posts.join(lists.select("signature", "pivot"), "signature"), "signatures")
    # First every list's documents are compared with its smallest, which joins most of what belongs together.
    pairs = posts.select(
        F.col("pivot.doc_id").alias("a"), F.col("pivot.size").alias("a_size"), F.col("pivot.common").alias("a_common"), *_side_columns("b")
    )
    verified = stored(_verified(_ordered(pairs.where(_fit(percent))), sets, percent).withColumn("turn", F.lit(0)), "pairs")
    posts, pivots, turns, rounds = posts.drop("pivot").withColumn("component", F.col("doc_id")), MOST_PIVOTS, 0, 0
    groups = None
    while True:
        links = verified.where("linked").select("a", "b", "shared", "of")
        # Without a new link the components are what they were.
        grown = groups is None or not verified.where(F.col("linked") & (F.col("turn") == rounds)).isEmpty()
        now, rounds = posts, rounds + 1
        if grown:
            groups = components(links)
            now = posts.drop("component").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn(
                "component", F.coalesce("component", "doc_id")
            )
        parts = now.groupBy("signature", "component").agg(F.count("*").alias("n"))
        mixed = parts.groupBy("signature").agg(
            F.max(F.struct("n", "component")).alias("largest"), F.sum("n").alias("length"), F.count("*").alias("parts")
        ).where("parts > 1")
        mixed = mixed.select("signature", F.col("largest.component").alias("main"), (F.col("length") - F.col("largest.n")).alias("others"))
        now = stored(now.join(mixed, "signature"), "signatures")
        if now.isEmpty():
            return membership, links, groups
        turns += 1
        if grown and turns < STAR_TURNS:
            # What lies outside a list's largest component is compared with one of that component, another one each turn.
            turn = F.xxhash64("signature", "doc_id", F.lit(turns))
            one = now.where("component = main").groupBy("signature").agg(
                F.min_by(F.struct("doc_id", "size", "common"), turn).alias("pivot")
            )
            pairs = now.where("component <> main").join(one, "signature").select(
                F.col("pivot.doc_id").alias("a"), F.col("pivot.size").alias("a_size"), F.col("pivot.common").alias("a_common"),
                *_side_columns("b"),
            )
            pairs = pairs.where(_fit(percent))
            posts = now.select("signature", "doc_id", "size", "common", "component")
        else:
            # Where that joins nothing more, it is compared with the whole list, some documents at a time.
            # Which ones follows from their hashes and the list's length, so that no task sees a whole list; by documents, not by
            # lists, so that all lists of a group of near copies choose the same ones.
            place = F.pmod(F.xxhash64("doc_id", F.lit(pivots)), F.lit(1 << 30)) * F.col("others")
            now = now.withColumn("head", (F.col("component") != F.col("main")) & (place < F.lit(pivots << 30)))
            pairs = _against_lists(now.where("head"), now, percent)
            posts = now.where((F.col("others") > pivots) & ~F.col("head")).select("signature", "doc_id", "size", "common", "component")
            pivots, turns = pivots * 2, STAR_TURNS
        pairs = _ordered(pairs).join(verified.select("a", "b"), ["a", "b"], "left_anti")
        verified = stored(verified.unionByName(_verified(pairs, sets, percent).withColumn("turn", F.lit(rounds))), "pairs")


def ngram_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id): texts whose sets of word n-grams are similar, directly or by way of others.

    Sets are similar where 100 * common >= percent * union. Words are lower-cased (A-Z) runs without ASCII white space;
    a text with fewer words than ``size`` is one n-gram; a null or blank one has none, and stays alone. Rows without
    doc_id are left out. Rows with the same doc_id and n-grams give one row, other rows of one id link as that id. Empty
    table: no rows. Further columns of ``docs`` don't matter.
    """
    membership, _, groups = _linked(docs, size, percent)
    return membership.join(groups.withColumnRenamed("id", "class_id"), "class_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id")
    )


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, of each component only those with its smallest doc_id; rows without doc_id stay."""
    dropped = ngram_components(docs, size, percent).where("component_id < doc_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(dropped, F.col("doc_id") == F.col("__id"), "left_anti")
