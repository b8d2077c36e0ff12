"""Nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-random rotation (signs and fast Hadamard
transforms, three times) and assigned to the nearest signed axis.  In each of
``TABLES`` tables a query looks into the ``PROBES`` buckets whose axes lie
nearest to it; what it finds is ranked by its exact inner product.

The nearest axis depends on the direction alone, so buckets hold what is near
by angle, whatever its norm.  A long vector can be among the largest inner
products at an angle that buckets often miss.  So once a query's last score is
known, the stored vectors long enough to beat it below ``safe_cosine`` are
compared with it one and all, by ranges of norms; a query with too few finds
is compared with all.

A bucket is dealt out in blocks of bounded size, and so are the queries that
look into it; one task compares one block with another.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import materialise

TABLES = 8
PROBES = 14
NEAREST = 20
SEED = 42
# Stored vectors and queries of one comparison.
BLOCK, QUERY_BLOCK = 4096, 4096
# What buckets find less often than this is compared without them.
FOUND = 0.9
# Ranges of norms for each doubling.
RANGES = 8
# Number of the table that stands for comparisons without buckets.
EXACT = -1


def hadamard(y: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, orthonormal."""
    n, d = y.shape
    h = 1
    while h < d:
        y = y.reshape(n, -1, 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return y / np.sqrt(d)


def rotations(x: np.ndarray, tables: int, seed: int = SEED) -> Iterator[np.ndarray]:
    """The rows of x under each table's rotation, padded to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    draw = np.random.default_rng(seed)
    for _ in range(tables):
        y = x
        for signs in draw.choice([-1.0, 1.0], (3, d)):
            y = hadamard(y * signs)
        yield y


def signed_axes(y: np.ndarray, probes: int = 1) -> np.ndarray:
    """The nearest ``probes`` signed axes of every row, nearest first."""
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    if probes == 1:
        return both.argmax(axis=1)[:, None]
    probes = min(probes, both.shape[1])
    best = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(both, best, 1), axis=1, kind="stable")
    return np.take_along_axis(best, order, 1)


@lru_cache
def safe_cosine(width: int, tables: int, probes: int, pairs: int = 4000) -> float:
    """The least cosine, and not below 0, from which on buckets find ``FOUND`` of the pairs or more.

    Measured on random pairs of vectors under the rotations in use.
    """
    d = 1 << max(1, (width - 1).bit_length())
    if probes >= 2 * d:
        return 0.0
    draw = np.random.default_rng(SEED + 1)
    u, w = draw.normal(size=(2, max(500, min(pairs, (1 << 20) // d)), d))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    turned = list(zip(rotations(u, tables), rotations(w, tables), strict=True))
    looked = [signed_axes(a, probes) for a, _ in turned]

    def found(c: float) -> float:
        hit = np.zeros(len(u), bool)
        for (a, b), axes in zip(turned, looked, strict=True):
            hit |= (signed_axes(c * a + np.sqrt(1 - c * c) * b) == axes).any(1)
        return hit.mean()

    low, high = 0.0, 1.0
    if found(low) >= FOUND:
        return low
    for _ in range(8):
        middle = (low + high) / 2
        low, high = (low, middle) if found(middle) >= FOUND else (middle, high)
    return high


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, vector)`` in double precision, of rows with an id and a finite vector that is not zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vector", lambda x: x != 0))


def _hashed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """``(t, bucket, vec_id, vector)``: a row for each table and probe; the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            by_width: dict = {}
            for i, v in enumerate(batch.column(1).to_pylist()):
                by_width.setdefault(len(v), []).append((i, v))
            for found in by_width.values():
                at = np.array([i for i, _ in found])
                x = np.array([v for _, v in found])
                raw = [r.tobytes() for r in x]
                for t, y in enumerate(rotations(x, tables)):
                    axes = signed_axes(y, probes)
                    n = axes.shape[1]
                    yield pa.record_batch(
                        [
                            pa.array(np.full(axes.size, t, np.int32)),
                            pa.array(axes.ravel().astype(np.int32)),
                            pa.array(np.repeat(ids[at], n)),
                            pa.array([r for r in raw for _ in range(n)], pa.binary()),
                        ],
                        names=["t", "bucket", "vec_id", "vector"],
                    )

    return rows.mapInArrow(run, "t int, bucket int, vec_id long, vector binary")


def _in_bytes(rows: DataFrame) -> DataFrame:
    """``(vec_id, vector, width, norm)``; the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [np.array(v) for v in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([v.tobytes() for v in x], pa.binary()),
                    pa.array([len(v) for v in x], pa.int32()),
                    pa.array([float(np.linalg.norm(v)) for v in x], pa.float64()),
                ],
                names=["vec_id", "vector", "width", "norm"],
            )

    return rows.mapInArrow(run, "vec_id long, vector binary, width int, norm double")


def _dealt(rows: DataFrame, own: str, other: str, sizes: DataFrame) -> DataFrame:
    """Rows of a bucket in one of its own blocks, once for every block of the other side."""
    placed = rows.join(F.broadcast(sizes), ["t", "bucket"])
    mine = F.pmod(F.xxhash64("vec_id"), F.col(f"{own}_blocks")).cast("int")
    theirs = F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1))
    return placed.withColumn(own, mine).withColumn(other, theirs).drop("own_blocks", "query_blocks")


def _compare(nearest: int):
    def run(key, queries: pd.DataFrame, stored: pd.DataFrame) -> pd.DataFrame:
        out = []
        widths = {len(v) for v in queries.vector} & {len(v) for v in stored.vector}
        for width in widths:
            q = queries[queries.vector.str.len() == width]
            s = stored[stored.vector.str.len() == width]
            a = np.frombuffer(b"".join(q.vector), float).reshape(len(q), -1)
            b = np.frombuffer(b"".join(s.vector), float).reshape(len(s), -1)
            qid, sid = q.vec_id.to_numpy(), s.vec_id.to_numpy()
            for at in range(0, len(a), 256):
                score = a[at : at + 256] @ b.T
                score[qid[at : at + 256, None] == sid[None, :]] = -np.inf
                if score.shape[1] > nearest:
                    bound = -np.partition(-score, nearest - 1, axis=1)[:, nearest - 1]
                    # products summed in another order may differ in the last digits
                    close = score >= (bound - 1e-9 * (1 + np.abs(bound)))[:, None]
                else:
                    close = np.ones(score.shape, bool)
                i, j = np.nonzero(close & (score > -np.inf))
                exact = (a[at + i] * b[j]).sum(axis=1)
                found = pd.DataFrame({"query_id": qid[at + i], "vec_id": sid[j], "score": exact})
                found = found.drop_duplicates(["query_id", "vec_id"]).sort_values(
                    ["query_id", "score", "vec_id"], ascending=[True, False, True]
                )
                out.append(found.groupby("query_id").head(nearest))
        if not out:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
                {"query_id": "int64", "vec_id": "int64", "score": "float64"}
            )
        return pd.concat(out)

    return run


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def _ranked(best: DataFrame, nearest: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _compared(index: DataFrame, looked: DataFrame, nearest: int) -> DataFrame:
    """``(query_id, vec_id, score)``: the nearest of each block that a query looks into."""
    # a few hundred rows: one for each table and axis
    sizes = index.groupBy("t", "bucket").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("own_blocks")
    ).join(
        looked.groupBy("t", "bucket").agg(
            F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("query_blocks")
        ),
        ["t", "bucket"],
    )
    sizes = materialise(sizes, "ann-sizes")
    place = ["t", "bucket", "own", "query"]
    found = (
        _dealt(looked, "query", "own", sizes)
        .groupBy(*place)
        .cogroup(_dealt(index, "own", "query", sizes).groupBy(*place))
        .applyInPandas(_compare(nearest), "query_id long, vec_id long, score double")
    )
    return _best(found)


def _unsure(
    stored: DataFrame, asked: DataFrame, ranked: DataFrame, nearest: int, tables: int, probes: int
) -> tuple[DataFrame, DataFrame] | None:
    """Stored vectors by range of norms, and queries by the ranges that buckets do not settle.

    A vector beats a query's last score s below the cosine c only with a norm
    above s / (c |query|).  Without a full list or a positive score any may.
    """
    queries = materialise(_in_bytes(asked), "ann-asked")
    widths = [r.width for r in queries.select("width").distinct().collect()]
    cosines = queries.sparkSession.createDataFrame(
        [(w, safe_cosine(w, tables, probes)) for w in widths], "width int, cosine double"
    )
    last = ranked.where(F.col("rank") == nearest).select(F.col("query_id").alias("vec_id"), "score")
    reach = F.col("cosine") * F.col("norm")
    limit = F.when(F.coalesce(F.col("score") <= 0, F.lit(True)), 0.0).when(reach > 0, F.col("score") / reach)
    short = queries.join(last, "vec_id", "left").join(F.broadcast(cosines), "width")
    short = short.withColumn("limit", limit).where("limit IS NOT NULL")
    short = materialise(short.select("vec_id", "vector", "width", "limit"), "ann-short")
    if short.isEmpty():
        return None
    span = F.floor(F.log2("norm") * RANGES).cast("int")
    # a norm that underflows to zero or overflows still has a range
    span = F.when(F.col("norm") > 0, span).otherwise(F.lit(-(1 << 31)))
    held = materialise(_in_bytes(stored).withColumn("bucket", span), "ann-ranges")
    longest = held.groupBy("bucket", "width").agg(F.max("norm").alias("longest"))
    longest = materialise(longest, "ann-longest")
    looked = short.join(F.broadcast(longest), "width").where(F.col("longest") >= F.col("limit"))
    looked = materialise(looked.select(F.lit(EXACT).alias("t"), "bucket", "vec_id", "vector"), "ann-exact")
    if looked.isEmpty():
        return None
    return held.select(F.lit(EXACT).alias("t"), "bucket", "vec_id", "vector"), looked


def search(
    vectors: DataFrame,
    queries: DataFrame,
    nearest: int = NEAREST,
    tables: int = TABLES,
    probes: int = PROBES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: of each query the nearest vectors found.

    Rows without an id and vectors that are null, zero or not finite take no
    part.  A query never finds rows of its own id; an id stored several times
    is found once, with its best score; ties go to the smaller id.  Vectors are
    compared with those of their own width; a query with fewer than ``nearest``
    finds is compared with all of them.  An empty side gives no rows.
    """
    stored = materialise(usable(vectors, id_col, vector_col), "ann-vectors")
    asked = materialise(usable(queries, id_col, vector_col), "ann-queries")
    index = materialise(_hashed(stored, tables, 1), "ann-index")
    looked = materialise(_hashed(asked, tables, probes), "ann-probes")
    best = materialise(_compared(index, looked, nearest), "ann-found")
    more = _unsure(stored, asked, _ranked(best, nearest), nearest, tables, probes)
    if more is not None:
        best = _best(best.unionByName(_compared(*more, nearest)))
    return _ranked(best, nearest)
