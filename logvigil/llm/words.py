"""Words and their hashes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Runs of other characters than ASCII white space; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def word_hashes(text: Column) -> Column:
    """64-bit hash of every word."""
    return F.transform(words(text), lambda w: F.xxhash64(w))
