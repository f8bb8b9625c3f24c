"""Benchmark items in texts, also with other numbers, names or units, by canonical templates.

Numbers, names and units become typed placeholders. Windows of the templates, and of the words without their case, are
hash-joined with those of the items; along each alignment that is found, what fills the placeholders must be put for one another consistently. Only
DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window, a power of two, and how many of them must be words, not placeholders.
WINDOW, LITERAL = 8, 4
#: Windows of items that are sent to every task; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
# Common units of measure.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz ml l s sec min h hr hrs day days week weeks month months year years second seconds "
    "minute minutes hour hours meter meters metre metres mile miles gram grams kilogram kilograms liter liters litre litres "
    "dollar dollars euro euros cent cents usd eur percent degree degrees"
).split()
#: Signs and currency marks that may stand before a number.
_MARKS = "+-\u2212\u00b1~#$\u20ac\u00a3\u00a5\u00a2\u20b9"
#: The two smaller windows that one of each size is put together from.
_PARTS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 5: (4, 1), 6: (4, 2), 7: (4, 3), 8: (4, 4)}
_SEPARATORS = "\t\n\x0b\x0c\r.,;:!?\"()[]{}<>|"
NUMBER, NAME, UNIT = 1, 2, 3


def _words(text: str) -> Column:
    """Words without punctuation around or in them."""
    plain = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _SEPARATORS, " " * len(_SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _token(word: Column) -> Column:
    """A placeholder's number, or the hash of the word."""
    digit = F.ascii(F.ltrim(word, F.lit(_MARKS))).between(48, 57)
    return F.when(digit, NUMBER).when(word != F.lower(word), NAME).when(word.isin(UNITS), UNIT).otherwise(F.xxhash64(word))


def _folded(word: Column) -> Column:
    """The hash of the word whatever its case; that of a word which is no placeholder equals its token."""
    return F.xxhash64(F.lower(word))


def _joined(first: Column, second: Column, size: int) -> Column:
    """Windows of ``first``, of ``size`` words, each with the one of ``second`` right behind it."""
    whole = F.greatest(F.size(second) - size, F.lit(0))
    return F.zip_with(F.slice(first, 1, whole), F.slice(second, size + 1, whole), lambda a, b: F.xxhash64(a, b))


def _windows(rows: DataFrame, id_column: str, sizes: list[int], *others: str) -> DataFrame:
    """(id, others, at, size, typed, folded): two hashes for each place of the text and size of a window."""
    found = rows.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("bigint").alias(id_column), *others,
        F.transform(_words("text"), _token).alias("t1"), F.transform(_words("text"), _folded).alias("f1"),
    )
    for n, (a, b) in _PARTS.items():  # a step at a time, so that no array is made twice; unused sizes are pruned
        found = found.select("*", *[_joined(F.col(f"{x}{a}"), F.col(f"{x}{b}"), a).alias(f"{x}{n}") for x in "tf"])
    def zipped(n: int) -> Column:
        # no lambda that looks up the other array: that would make it again for each place
        both = F.arrays_zip(f"t{n}", f"f{n}").cast("array<struct<typed:bigint,folded:bigint>>")
        return F.struct(F.lit(n).alias("size"), both.alias("both"))

    # outer: else a filter on the arrays' sizes would compute them once more, nested in each other
    each = found.select(id_column, *others, F.explode_outer(F.array(*map(zipped, sizes))).alias("w"))
    places = each.select(id_column, *others, "w.size", F.posexplode_outer("w.both").alias("at", "hashes"))
    return places.select(id_column, *others, "size", "at", "hashes.typed", "hashes.folded")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, first_word, exact): items that a text holds, one row for each pair.

    A text holds an item where at least one window of 8 words has the item's template, with at least 4 words that aren't
    placeholders, or the item's words whatever their case, and along that alignment equal fillings of placeholders stand
    for equal ones and unlike for unlike ones. An item of fewer words is one window as a whole. ``exact``: the fillings are
    the item's. Null texts and items hold nothing. Rows without id are left out; repeated rows count as one text. Empty
    tables: no rows. Further columns don't matter.
    """
    items = benchmark.select("item_id", "text")
    placeholder = F.transform(_words("text"), lambda w: (_token(w).isin(NUMBER, NAME, UNIT)).cast("int"))
    literal = items.where("item_id IS NOT NULL").select(
        F.col("item_id").cast("bigint").alias("item_id"), "text", placeholder.alias("slots")
    )
    lengths = literal.agg(F.collect_set(F.least(F.size("slots"), F.lit(WINDOW)))).first()[0]
    sizes = sorted({WINDOW, *lengths} - {0})
    placed = _windows(literal, "item_id", sizes, "slots").where(F.col("size") == F.least(F.size("slots"), F.lit(WINDOW)))
    held = F.aggregate(F.slice("slots", F.col("at") + 1, F.col("size")), F.lit(0), lambda a, b: a + b)
    enough = held <= F.col("size") - F.least(F.col("size"), F.lit(LITERAL))
    of_items = placed.select(
        "item_id", F.col("at").alias("place"), F.explode(F.array(F.when(enough, F.col("typed")), F.col("folded"))).alias("window")
    ).where("window IS NOT NULL").distinct()
    bounded = of_items.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    of_items = F.broadcast(of_items) if bounded else of_items
    own = docs.select("doc_id", "text")
    both_kinds = F.array(F.col("typed"), F.when(F.col("folded") != F.col("typed"), F.col("folded")))
    hits = (
        _windows(own, "doc_id", sizes).select("doc_id", "at", F.explode(both_kinds).alias("window"))
        .join(of_items, "window").select("doc_id", "item_id", "at", "place").distinct()
    )
    # alignments whole: what fills the placeholders of all their windows
    lines = hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("place")).alias("shift")).agg(
        F.collect_set("place").alias("places"), F.min("at").alias("first_word")
    )
    left = own.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    right = literal.select("item_id", _words("text").alias("item_words"), "slots").dropDuplicates(["item_id", "item_words"])
    both = lines.join(left, "doc_id").select(*lines.columns, _words("text").alias("words")).join(right, "item_id")
    fillings = F.array_distinct(
        F.flatten(
            F.transform(
                "places",
                lambda p: F.filter(
                    F.transform(
                        F.sequence(p + 1, p + WINDOW),
                        lambda i: F.when(
                            F.get("slots", i - 1) == 1,
                            F.struct(F.get("item_words", i - 1).alias("theirs"), F.get("words", i - 1 + F.col("shift")).alias("ours")),
                        ),
                    ),
                    lambda s: s.isNotNull(),
                ),
            )
        )
    )
    checked = both.select("doc_id", "item_id", "first_word", F.size("places").alias("n"), fillings.alias("f"))
    lower = F.array_distinct(F.transform("f", lambda s: F.struct(F.lower(s["theirs"]).alias("theirs"), F.lower(s["ours"]).alias("ours"))))

    def consistent(name: str) -> Column:
        one = lambda part: F.size(F.array_distinct(F.transform(name, lambda s: s[part]))) == F.size(name)
        return one("theirs") & one("ours")

    return (
        checked.withColumn("g", lower).where(consistent("f") | consistent("g"))
        .withColumn("exact", F.forall("f", lambda s: s["theirs"] == s["ours"]))
        .groupBy("doc_id", "item_id").agg(
            F.max("n").cast("bigint").alias("n_windows"), F.min("first_word").cast("bigint").alias("first_word"),
            F.bool_or("exact").alias("exact"),
        )
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose text holds no item, as they are; rows without doc_id stay."""
    found = leaks(docs, benchmark).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(found, F.col("doc_id").cast("bigint") == F.col("__id"), "left_anti")
