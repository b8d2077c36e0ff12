"""Deterministic keys and seeds (survey F08, F13 and the order key)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import let

SEED = 42
NULL_KEY = "nan"
KEY_SEPARATOR = "__"
# Hex digits of the order key that make a bucket: 16**4 uniform buckets.
BUCKET_DIGITS = 4


def order_key(row_id: Column, seed: int = SEED) -> Column:
    """A uniform, partition-independent random order of rows."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), row_id.cast("string")))


def key_bucket(key: Column) -> Column:
    return F.substring(key, 1, BUCKET_DIGITS)


def text_seed(text: Column) -> Column:
    """the sha-256 of the text, as a number, modulo 10**8.

    The 64 hex digits are folded eight at a time: every step fits a long.
    """

    def fold(digest: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), F.lit(7)),
            lambda i: F.conv(F.substring(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long"),
        )
        return F.aggregate(
            chunks,
            F.lit(0).cast("long"),
            lambda acc, c: (acc * 4294967296 + c) % 100_000_000,
        )

    return let(F.sha2(text, 256), fold)


def composite_key(*columns: str) -> Column:
    """column values joined by ``__``; a null is spelled out, not dropped."""
    return F.concat_ws(
        KEY_SEPARATOR,
        *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_KEY)) for c in columns],
    )


def text_identity(text: Column) -> Column:
    """A 256-bit stand-in for the text, so that shuffles move no long strings."""
    return F.unhex(F.sha2(text, 256))
