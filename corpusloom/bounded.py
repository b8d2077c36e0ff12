"""Size-checked broadcasts.

A side is broadcast only after its row count and byte size were measured; a
side beyond the bound goes through an ordinary shuffle join, where AQE splits
hot keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import materialise

MAX_ROWS = 100_000
MAX_BYTES = 32 * 1024 * 1024


def small_rows(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES):
    """The rows of ``df`` if they fit the bound, else ``None``.

    Rows and bytes are counted on the executors, at most one row past the bound
    of them; rows reach the driver only after that.
    """
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, total = (
        df.limit(max_rows + 1).select(size.alias("n")).agg(F.count("*"), F.sum("n")).first()
    )
    if rows > max_rows or (total or 0) > max_bytes:
        return None
    return df.collect()


def checked(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``df`` as a broadcast table of proven size, or as a written table if too big.

    ``df`` is evaluated once: what is measured is what is joined.
    """
    table = materialise(df, "bounded")
    rows = small_rows(table, max_rows, max_bytes)
    if rows is None:
        return table
    local = df.sparkSession.createDataFrame(rows, df.schema)
    return F.broadcast(local)


def join_checked(
    big: DataFrame,
    small: DataFrame,
    on: str | list[str] | Column,
    how: str = "inner",
    max_rows: int = MAX_ROWS,
) -> DataFrame:
    """Join a large frame with an aggregate that is usually tiny."""
    return big.join(checked(small, max_rows), on, how)
