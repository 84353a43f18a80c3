"""Canonical text of keys and values, their digests, and the level that a key's digest gives it.

All expressions are built-in functions, so they stay in generated code and DuckDB can compute the same text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSENT = "~"
ALGORITHMS = ("sha224", "sha256", "sha384", "sha512", "sha1", "md5")


def digest(text: Column, algorithm: str = "sha256") -> Column:
    """Lower-case hex digest of a text column."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown hash algorithm {algorithm!r}; one of {', '.join(ALGORITHMS)}")
    if algorithm in ("sha1", "md5"):
        return getattr(F, algorithm)(text.cast("binary"))
    return F.sha2(text, int(algorithm[3:]))


def prefixed(text: Column) -> Column:
    """length ':' text, and ABSENT for null: no two sequences of fields share a concatenation."""
    return F.when(text.isNull(), F.lit(ABSENT)).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text))


def canonical(columns: list[Column]) -> Column:
    """One column as its text, several as the concatenation of their prefixed texts."""
    texts = [c.cast("string") for c in columns]
    return texts[0] if len(texts) == 1 else F.concat(*map(prefixed, texts))


def level_of(key_text: Column, algorithm: str = "sha256") -> Column:
    """Leading zero hex digits of the digest of a key's text."""
    found = digest(key_text, algorithm)
    return (F.length(found) - F.length(F.ltrim(found, F.lit("0")))).cast("int")
