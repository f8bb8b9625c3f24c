"""Column expressions over snippet text. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark import constants as C

# Runs of anything but whitespace, the same code points as in C.WHITESPACE; one property test per
# character is several times faster than listing them.
_WORD = r"(?U)[^\s\x1C-\x1F]+"

# Identifiers, numbers, and every other visible character on its own.
TOKEN_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^ \t\n\r\f\x0BA-Za-z_0-9]"

HASH_BITS = 60


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Text without leading and trailing whitespace of any kind (``trim`` removes blanks only)."""
    return F.btrim(_col(c), F.lit(C.WHITESPACE))


def normalize_language(c: Column | str) -> Column:
    """Lower-cased, stripped language name; missing becomes ``unknown``."""
    return F.coalesce(F.lower(strip(c)), F.lit(C.UNKNOWN))


def n_chars(c: Column | str) -> Column:
    return F.length(_col(c)).cast("bigint")


def n_lines(c: Column | str) -> Column:
    """Line feeds plus one; the empty text has one line."""
    c = _col(c)
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def n_whitespace_tokens(c: Column | str) -> Column:
    return F.regexp_count(_col(c), F.lit(_WORD)).cast("bigint")


def digest(c: Column | str) -> Column:
    """32-byte key that stands in for the text in shuffles."""
    return F.unhex(F.sha2(_col(c), 256))


def seeded_key(seed: int | str, *ids: Column | str) -> Column:
    """Uniform 60-bit BIGINT from a seed and a row key: the order key of all seeded draws.

    A pure function of its inputs, so a draw does not depend on partitioning.
    """
    joined = F.concat_ws(":", F.lit(str(seed)), *[_col(i).cast("string") for i in ids])
    return F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("bigint")


def tokens(c: Column | str) -> Column:
    """Code-aware tokens of the whole text."""
    return F.regexp_extract_all(_col(c), F.lit(TOKEN_PATTERN), F.lit(0))


def label_name(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c == C.HUMAN, C.LABEL_NAMES[C.HUMAN]).when(c == C.AI, C.LABEL_NAMES[C.AI])
