"""PCA whitening of vectors by distributed block matrices.

Rows are numbered without gaps, centred and laid out as blocks of a BlockMatrix.
Its transpose times itself is the scatter, summed over as many parts as there are
stretches of row blocks, so no task sees more than a few blocks.  The scatter is
as wide as a vector, whatever the number of rows: its eigenvectors are worked out
on the driver, and the blocks times the whitening matrix are the whitened rows.

Row blocks are numbered on the driver by MLlib, so a table of very many rows goes
through in slabs of a bounded number of blocks whose scatters are added up.
"""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.session import materialise

COMPONENTS = 32
# The scatter and its eigenvectors are on the driver: this width is 128 MB each.
MAX_WIDTH = 4096
# Numbers in a block (16 MB), and row blocks that MLlib lists on the driver at once.
BLOCK_NUMBERS, SLAB_BLOCKS = 1 << 21, 1 << 15
# Row blocks whose products one task adds up.
BLOCKS_IN_TASK = 8
# Bits in which monotonically_increasing_id numbers the rows of a partition.
_PLACE_BITS = 33
LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """True for a vector without null and non-finite entries."""
    finite = F.forall(
        vector,
        lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")),
    )
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite, F.lit(False))


def numbered(rows: DataFrame, out_col: str = "_index") -> DataFrame:
    """Written rows numbered from 0 without gaps; only one count for each partition is sorted."""
    placed = materialise(rows.withColumn("_at", F.monotonically_increasing_id()), "whitening-rows")
    part = F.shiftright("_at", _PLACE_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    starts = sizes.select("_part", before.alias("_start"))
    return (
        placed.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(out_col, F.col("_start") + F.col("_at").bitwiseAND((1 << _PLACE_BITS) - 1))
        .drop("_at", "_part", "_start")
    )


def _row_blocks(n: int, width: int) -> int:
    """Rows of a block: few enough for memory, and several blocks also for small tables."""
    return max(16, min(BLOCK_NUMBERS // width, ceil(n / 16)))


def _slabs(n: int, width: int) -> list[tuple[int, int]]:
    step = _row_blocks(n, width) * SLAB_BLOCKS
    return [(a, min(n, a + step)) for a in range(0, n, step)]


def _blocks(rows: DataFrame, slab: tuple[int, int], n: int, width: int) -> BlockMatrix:
    """Blocks of the rows ``(index, v)`` of a slab; ``v`` is an array of doubles."""
    a, b = slab
    held = rows.where(F.col("index").between(a, b - 1))
    held = held.select((F.col("index") - a).alias("index"), array_to_vector("v").alias("vector"))
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(held, "vector"), b - a, width)
    return indexed.toBlockMatrix(_row_blocks(n, width), width)


def _scatter(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """Sum of v v' over the rows ``(index, v)``, by blocks' transpose times blocks."""
    total = np.zeros((width, width))
    for slab in _slabs(n, width):
        blocks = _blocks(rows, slab, n, width)
        tasks = ceil((slab[1] - slab[0]) / _row_blocks(n, width) / BLOCKS_IN_TASK)
        across = blocks.transpose()
        # the sum over the row blocks is dealt out to this many tasks
        java = across._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, tasks)
        product = BlockMatrix(java, width, width)
        total += product.toLocalMatrix().toArray()
    return total


def _projected(rows: DataFrame, n: int, width: int, turn: np.ndarray) -> DataFrame:
    """``(index, v)``: the rows ``(index, v)`` times the matrix ``turn``."""
    sc, k, found = rows.sparkSession.sparkContext, turn.shape[1], None
    flat = DenseMatrix(width, k, turn.ravel(order="F"))
    turning = BlockMatrix(sc.parallelize([((0, 0), flat)], 1), width, k)
    for slab in _slabs(n, width):
        product = _blocks(rows, slab, n, width).multiply(turning).toIndexedRowMatrix()
        # as a table, without a way through Python
        table = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
        part = table.select((F.col("index") + slab[0]).alias("index"), vector_to_array("vector").alias("v"))
        found = part if found is None else found.unionByName(part)
    return found


def moments(rows: DataFrame, vector: Column) -> tuple[int, list, list, list]:
    """(number of rows, and sums, least and largest entries by dimension), sums exact for whole numbers."""
    of = (
        rows.select(F.posexplode(vector).alias("d", "x"))
        .groupBy("d")
        .agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.min("x").alias("a"), F.max("x").alias("b"))
        .orderBy("d")
        .collect()
    )  # a row for each dimension
    return (of[0].n if of else 0), [r.s for r in of], [r.a for r in of], [r.b for r in of]


def same_width(rows: DataFrame, vector_col: str) -> tuple[DataFrame, int]:
    """The rows with a usable vector of the commonest width (of equal ones the least), and that width."""
    good = rows.where(usable(F.col(vector_col)))
    sizes = good.groupBy(F.size(vector_col).alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = sizes.w if sizes else 0
    if width > MAX_WIDTH:
        raise ValueError(f"vectors of {width} entries; at most {MAX_WIDTH}")
    return good.where(F.size(vector_col) == width), width


def whiten(
    rows: DataFrame, k: int = COMPONENTS, vector_col: str = "vector", columns: tuple[str, ...] = ("vec_id",)
) -> tuple[DataFrame, dict]:
    """Whitened rows and what was fitted, over all rows.

    The table has ``columns``, the vector and ``whitened``: the centred vector on the
    first ``k`` components (unit eigenvectors of the covariance, divisor n, by falling
    eigenvalue), each over the root of its eigenvalue.  The fit is a dictionary of
    ``n``, ``sums``, ``least`` and ``largest`` by dimension, ``values`` (all
    eigenvalues), ``components`` (as columns), ``explained`` (shares of the trace) and
    ``identity_error``: the largest absolute entry of the covariance of the whitened
    rows minus the identity.

    Rows whose vector is null, empty, of another width than most, or holds null or
    non-finite entries take no part.  Equal rows and ids, also null ones, count and
    return one by one.  A component without variance (eigenvalue below rounding:
    constant dimensions, fewer rows than dimensions) is null in ``whitened`` and left
    out of ``identity_error``, which is null if none is left.  Without rows the table
    is empty.  Other columns are dropped.
    """
    good, width = same_width(rows, vector_col)
    good = numbered(good.select(*columns, F.col(vector_col).alias(vector_col)))
    n, sums, least, largest = moments(good, F.col(vector_col))
    if not n:
        empty = good.select(*columns, vector_col, F.array().cast("array<double>").alias("whitened"))
        fit = {"n": 0, "sums": [], "least": [], "largest": [], "explained": [], "identity_error": None}
        return empty, fit | {"values": np.zeros(0), "components": np.zeros((0, 0))}
    mean = F.lit([float(s) / n for s in sums])
    away = F.zip_with(F.col(vector_col), mean, lambda x, m: x.cast("double") - m)
    centred = good.select(F.col("_index").alias("index"), away.alias("v"))
    values, vectors = np.linalg.eigh(_scatter(centred, n, width) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(values.sum())
    k = min(k, width)
    rounding = width * np.finfo(float).eps * max(float(values[0]), 0.0)
    live = int((values[:k] > rounding).sum())
    turn = vectors[:, : max(live, 1)] / np.sqrt(np.maximum(values[: max(live, 1)], np.finfo(float).tiny))
    white = materialise(_projected(centred, n, width, turn), "whitening-white")
    error = None
    if live:
        _, total, _, _ = moments(white, F.col("v"))
        again = F.zip_with("v", F.lit([t / n for t in total]), lambda x, m: x - m)
        covariance = _scatter(white.select("index", again.alias("v")), n, live) / n
        error = float(np.abs(covariance - np.eye(live)).max())
    shown = F.slice("v", 1, live) if live else F.array().cast("array<double>")
    filled = F.concat(shown, F.array_repeat(F.lit(None).cast("double"), k - live))
    found = good.join(white.select(F.col("index").alias("_index"), filled.alias("whitened")), "_index")
    fit = {
        "n": n, "sums": sums, "least": least, "largest": largest, "values": values, "components": vectors[:, :k],
        "explained": [float(v) / trace if trace > 0 else 0.0 for v in values[:k]], "identity_error": error,
    }
    return found.select(*columns, vector_col, "whitened"), fit


def deviation(vector: Column, fit: dict) -> Column:
    """Sum over the dimensions of (n x - S)^2 of vectors of whole numbers: exact, null beyond a long."""
    n, sums = fit["n"], fit["sums"]
    ends = list(zip(fit["least"], fit["largest"], sums, strict=True))
    furthest = sum(max(abs(n * a - s), abs(n * b - s)) ** 2 for a, b, s in ends)
    if furthest <= LONG and all(n * max(abs(a), abs(b)) <= LONG for a, b, _ in ends):
        away = F.zip_with(vector, F.lit([int(s) for s in sums]), lambda x, s: F.lit(n) * x - s)
        return F.aggregate(away, F.lit(0).cast("long"), lambda total, d: total + d * d)

    def number(value: int | Column, digits: int = 38) -> Column:
        return (F.lit(str(value)) if isinstance(value, int) else value).cast(f"decimal({digits},0)")

    def square(x: Column, s: Column) -> Column:
        away = F.try_subtract(F.try_multiply(number(n, 19), number(x, 19)), s)
        # the square of any other is beyond a long
        near = F.abs(away) < number(10**10)
        return F.when(near, number(F.when(near, away), 11) * number(F.when(near, away), 11)).cast("decimal(38,0)")

    squares = F.zip_with(vector, F.array(*[number(int(s)) for s in sums]), square)
    total = F.aggregate(squares, number(0), lambda t, d: number(t + d))
    return F.when(total <= number(LONG), total).cast("long")
