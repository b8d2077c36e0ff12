"""Principal components of wide vectors (survey M03), without a width x width matrix.

A random panel of ``k + OVERSAMPLE`` directions is multiplied by the covariance again and
again; each product is one pass over the rows, which never leave their tasks.  Tasks return
a panel (width x directions) by columns, summed by a shuffle; only the sum reaches the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OVERSAMPLE = 10
# Entries of a panel at most (128 MiB of doubles in the driver and in each Python worker).
MAX_PANEL = 1 << 24
# Products of an entry and a panel row that are held at once in a task.
_CHUNK = 1 << 20
_OUT_ROWS = 4096


def _entries(vectors: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the stored entries of sparse and dense vectors, in order of rows."""
    kinds, _, indices, values = vectors.flatten()
    lengths = values.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    column = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    sparse = kinds.fill_null(0).to_numpy(zero_copy_only=False) == 0
    column[sparse[row]] = indices.flatten().to_numpy()
    return row, column, values.flatten().to_numpy()


def _add(target: np.ndarray, key: np.ndarray, parts: np.ndarray) -> None:
    """Add ``parts`` to the rows ``key`` of ``target``; ``key`` rises."""
    starts = np.flatnonzero(np.diff(key, prepend=-1))
    target[key[starts]] += np.add.reduceat(parts, starts, axis=0)


def _project(entries, n_rows: int, panel: np.ndarray) -> np.ndarray:
    """Rows times panel."""
    row, column, value = entries
    out = np.zeros((n_rows, panel.shape[1]))
    step = max(1, _CHUNK // panel.shape[1])
    for i in range(0, len(row), step):
        s = slice(i, i + step)
        _add(out, row[s], panel[column[s]] * value[s, None])
    return out


def _project_back(entries, rows: np.ndarray, out: np.ndarray) -> None:
    """Add transposed vectors times ``rows`` to ``out``."""
    row, column, value = entries
    step = max(1, _CHUNK // rows.shape[1])
    for i in range(0, len(row), step):
        s = slice(i, i + step)
        order = np.argsort(column[s], kind="stable")
        _add(out, column[s][order], (rows[row[s]] * value[s, None])[order])


def _scatter_times(stored: DataFrame, mean: np.ndarray, panel: np.ndarray) -> np.ndarray:
    """The scatter matrix of the centred rows times ``panel``, in one pass."""
    sent = stored.sparkSession.sparkContext.broadcast(panel)
    shift = mean @ panel

    def of_task(batches):
        panel_ = sent.value
        out = np.zeros(panel_.shape)
        for batch in batches:
            entries = _entries(batch.column(0))
            # centred rows sum to zero, so the vectors behind need not be centred again
            _project_back(entries, _project(entries, batch.num_rows, panel_) - shift, out)
        used = np.flatnonzero(out.any(axis=1))
        for i in range(0, len(used), _OUT_ROWS):
            some = used[i : i + _OUT_ROWS]
            flat = pa.array(out[some].ravel())
            lists = pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * out.shape[1], flat)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), lists], ["j", "part"])

    parts = stored.mapInArrow(of_task, "j int, part array<double>")
    sums = F.array(*[F.sum(F.get("part", F.lit(i))) for i in range(panel.shape[1])])
    table = parts.groupBy("j").agg(sums.alias("total")).toArrow()
    result = np.zeros(panel.shape)
    if table.num_rows:
        totals = table["total"].combine_chunks().flatten().to_numpy()
        result[table["j"].to_numpy()] = totals.reshape(-1, panel.shape[1])
    sent.unpersist()
    return result


def principal_directions(
    df: DataFrame,
    n_components: int,
    in_col: str = "vector",
    seed: int = 42,
    max_passes: int = 30,
    tolerance: float = 1e-6,
) -> tuple[np.ndarray, np.ndarray, int]:
    """Directions (width x components), their variances (divisor n - 1), and the passes made.

    Stops when for each direction v the covariance times v is the variance times v up to
    ``tolerance`` of the largest variance, or after ``max_passes``: a spectrum that
    hardly falls needs many, and then directions of nearly equal variance are mixed.
    Null vectors take no part; a direction without variance is some unit vector.
    """
    kept = df.filter(F.col(in_col).isNotNull()).select(in_col)
    facts = kept.select(Summarizer.metrics("mean", "count").summary(F.col(in_col)).alias("s")).first()["s"]
    n, mean = facts["count"], facts["mean"].toArray()
    width = len(mean)
    k = min(n_components, width)
    directions = min(k + OVERSAMPLE, width)
    if n == 0:
        raise ValueError("no rows to reduce")
    if width * directions > MAX_PANEL:
        raise ValueError(f"{directions} directions of width {width} exceed {MAX_PANEL} numbers; hash them down")
    stored = kept.select(F.unwrap_udt(in_col).alias("v"))
    panel = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, directions)))[0]
    for passes in range(1, max_passes + 1):
        product = _scatter_times(stored, mean, panel) / max(n - 1, 1)
        small = panel.T @ product
        variances, turn = np.linalg.eigh((small + small.T) / 2)
        variances, turn = variances[::-1], turn[:, ::-1]
        found, moved = panel @ turn[:, :k], product @ turn[:, :k]
        off = np.linalg.norm(moved - found * variances[:k], axis=0)
        if off.max() <= tolerance * max(variances[0], np.finfo(float).tiny):
            break
        panel = np.linalg.qr(product)[0]
    return found, np.maximum(variances[:k], 0.0), passes


def project(df: DataFrame, directions: np.ndarray, in_col: str = "vector", out_col: str = "reduced") -> DataFrame:
    """Vectors times ``directions``, not centred, as ``PCA`` returns them; null stays null."""
    sent = df.sparkSession.sparkContext.broadcast(directions)

    @F.pandas_udf("array<double>")
    def reduced(v: pd.DataFrame) -> pd.Series:
        kinds, sizes = pa.array(v["type"], pa.int8()), pa.array(v["size"], pa.int32())
        indices = pa.array(v["indices"], pa.list_(pa.int32()))
        values = pa.array(v["values"], pa.list_(pa.float64()))
        stored = pa.StructArray.from_arrays([kinds, sizes, indices, values], ["type", "size", "indices", "values"])
        return pd.Series(list(_project(_entries(stored), len(v), sent.value)))

    vector = array_to_vector(reduced(F.unwrap_udt(in_col)))
    return df.withColumn(out_col, F.when(F.col(in_col).isNotNull(), vector))
