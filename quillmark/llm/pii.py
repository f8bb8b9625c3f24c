"""Personal data: spans of fixed kinds, and terms that tell about them by what the corpus knows.

Removing an address is not enough where the words around it only ever stand beside that address. Over all texts the
point-wise mutual information of a term and a protected entity, as a share of what the entity itself tells, measures how
far the term gives it away. Terms beyond one threshold are generalised, beyond a higher one removed.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.textops import Words, pieces, texts
from quillmark.session import stored

KINDS = ("email", "ip", "card", "phone")
#: Words on either side of an entity that may give it away.
REACH = 8
#: Texts in which term and entity must stand together for the corpus to be evidence.
EVIDENCE = 2
#: Share of an entity's information from which a term is generalised, and from which it is removed.
GENERALISE, REMOVE = 0.6, 0.8
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TERM_TABLE = np.where(_LETTERS, np.arange(256), 32).astype(np.uint8).tobytes()


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of fixed kinds, in code points, by kind and then start."""
    out = [("email", *s) for s in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]  # a part may have any number of zeros before it
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if len(m[0]) >= 13:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and _luhn(digits):
                    out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


def _name(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8"), digest_size=8).digest(), "little", signed=True)


def _lower(text: str) -> str:
    """Lower case for A-Z alone."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _terms_beside(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, bytes, int, int]]:
    """(entity, term, start, end) of the words within reach of an entity, others' spans left out."""
    covered = sorted((a, b) for _, a, b in spans)
    out = []
    for kind, start, end in spans:
        entity = _name(f"{kind}:{_lower(text[start:end])}")
        low, high = max(0, start - 40 * REACH), min(len(text), end + 40 * REACH)
        before = [m for m in _WORD.finditer(text, low, start)][-REACH:]
        after = [m for _, m in zip(range(REACH), _WORD.finditer(text, end, high))]
        for m in before + after:
            a, b = m.span()
            # a word cut by the edge of what was looked at, or part of an entity, is none
            if b - a < 3 or (a == low and a and text[a - 1].isalnum()) or (b == high and b < len(text) and text[b].isalnum()):
                continue
            if m[0].isdigit() or any(x < b and a < y for x, y in covered):
                continue
            out.append((entity, _lower(m[0]), a, b))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, text) of all rows: what a row's spans belong to is its id with its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text).alias("digest"), text.alias("text"))


def find_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, n_email, n_ip, n_card, n_phone, base, beside) of every row, also of those without id; null text: empty.

    ``digest`` is that of the text. ``base`` lists kind:start:end; ``beside`` the terms near entities, with their places.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        beside_type = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch, found in pieces(batches):
            counts, base, beside = [[], [], [], []], [], []
            for raw in found:
                text = raw.decode("utf-8")
                spans = base_spans(text)
                for kind, column in zip(KINDS, counts):
                    column.append(sum(s[0] == kind for s in spans))
                base.append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
                beside.append([dict(zip(("entity", "term", "start", "end"), x)) for x in _terms_beside(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("digest"), *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(base, pa.string()), pa.array(beside, beside_type),
                ],
                ["doc_id", "digest", "n_email", "n_ip", "n_card", "n_phone", "base", "beside"],
            )

    return _texts(docs).mapInArrow(
        run,
        "doc_id bigint, digest string, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, "
        "beside array<struct<entity:bigint,term:string,start:int,end:int>>",
    )


def _term_hash(words: list[str]) -> np.ndarray:
    found = Words([w.encode("utf-8").translate(_TERM_TABLE) for w in words], lower=True)
    return np.append(found.hash, np.uint64(0))[np.minimum(found.first[:-1], len(found.hash))].view(np.int64)


def term_counts(docs: DataFrame) -> DataFrame:
    """(term, texts): in how many texts each hashed term stands, over all texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send() -> pa.RecordBatch:
            terms, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts, pa.int64())], ["term", "texts"])

        for _, found in pieces(batches):
            words = Words([x.translate(_TERM_TABLE) for x in found], lower=True)
            for a, b in zip(words.first[:-1], words.first[1:]):
                held.append(np.unique(words.hash[a:b]))
                size += len(held[-1])
            if size > 2_000_000:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    return texts(docs).mapInArrow(run, "term bigint, texts bigint").groupBy("term").agg(F.sum("texts").alias("texts"))


def _hashed(beside: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("term")
            hashes = _term_hash(batch.column(at).to_pylist()) if batch.num_rows else np.empty(0, np.int64)
            yield batch.set_column(at, "term", pa.array(hashes, pa.int64()))

    return beside.mapInArrow(run, "doc_id bigint, digest string, entity bigint, term bigint, start int, end int")


def disclosing_terms(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> tuple[DataFrame, DataFrame]:
    """All texts' spans as ``find_spans`` gives them, and (doc_id, digest, start, end, share, kind) of terms that disclose an entity.

    ``share`` is how much of the entity's information the term tells: PMI(term, entity) / -log p(entity), counted over all
    texts with an id. An entity that all texts hold has no information, and no term tells of it. ``kind`` is term (removed) or
    context (generalised).
    """
    spans = stored(find_spans(docs), "personal")
    beside = stored(
        _hashed(spans.where(F.size("beside") > 0).select("doc_id", "digest", F.explode("beside").alias("x")).select("doc_id", "digest", "x.*")),
        "beside",
    )
    n = spans.where("doc_id IS NOT NULL").count()
    together = beside.groupBy("entity", "term").agg(F.count_distinct("doc_id").alias("both")).where(F.col("both") >= EVIDENCE)
    entities = beside.groupBy("entity").agg(F.count_distinct("doc_id").alias("entity_texts"))
    counted = together.join(entities, "entity").join(term_counts(docs), "term")
    pmi = F.log(F.col("both") * F.lit(float(n)) / (F.col("texts") * F.col("entity_texts")))
    told = F.try_divide(pmi, F.log(F.lit(float(n)) / F.col("entity_texts")))
    shares = counted.select("entity", "term", told.alias("share")).where(F.col("share") >= generalise)
    found = beside.join(shares, ["entity", "term"]).groupBy("doc_id", "digest", "start", "end").agg(F.max("share").alias("share"))
    return spans, found.withColumn("kind", F.when(F.col("share") >= remove, "term").otherwise("context"))


def _all_spans(docs: DataFrame) -> DataFrame:
    """`all_spans` with each text's digest, rows without id among them (``id`` is then the least number there is)."""
    spans, terms = disclosing_terms(docs)
    key = F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id")
    each = F.sort_array(F.collect_list(F.struct("kind", "start", "end")))
    added = terms.groupBy(key, "digest").agg(
        F.array_join(F.transform(each, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("added")
    )
    both = spans.drop("beside").withColumn("id", key).join(added, ["id", "digest"], "left")
    return both.select(
        "id", "digest", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base",
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("added")).alias("spans"),
    )


def all_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every text: base spans, and those with disclosing terms.

    Spans are kind:start:end in code points, the end exclusive, by kind (email, ip, card, phone, context, term) and then
    start. Null or empty text: none. Rows without doc_id are left out; unlike texts of one doc_id have their own spans each. Empty
    table: no rows. Further columns of ``docs`` don't matter.
    """
    return _all_spans(docs).where("doc_id IS NOT NULL").drop("id", "digest")


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced: entities by their kind, disclosing terms by [TERM] or nothing.

    Texts without spans and null ones stay as they are; all other columns too. Rows without doc_id are treated as well, though
    they are no evidence for what discloses an entity.
    """
    held = _all_spans(docs).where("spans <> ''").groupBy(F.col("id").alias("__id"), F.col("digest").alias("__digest")).agg(
        F.max("spans").alias("__spans")
    )
    names = docs.columns
    own = F.coalesce(docs["doc_id"].cast("bigint"), F.lit(-(1 << 63))) == F.col("__id")
    same = F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("__digest")
    both = docs.join(held, own & same, "left").select(*[docs[c] for c in names], "__spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            out = [replaced(t, s) if t and s else t for t, s in zip(batch.column("text").to_pylist(), batch.column("__spans").to_pylist())]
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).select(names)

    return both.mapInArrow(run, docs.schema)


def replaced(text: str, spans: str) -> str:
    """``text`` with spans replaced; of overlapping ones the first listed kind of each stretch counts."""
    found = sorted((int(a), -int(b), k) for k, a, b in (s.split(":") for s in spans.split(",")))
    out, last = [], 0
    for start, end, kind in found:
        end = -end
        if start < last:
            last = max(last, end)
            continue
        out += [text[last:start], {"term": "", "context": "[TERM]"}.get(kind, f"[{kind.upper()}]")]
        last = end
    return "".join([*out, text[last:]])
