import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import whitening
from corpusloom.llm.queries import QUERIES

NAMES = ("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def _rows(draw, n, width):
    mixed = draw.normal(size=(width, width)) * np.linspace(2, 0.2, width)
    return (draw.normal(size=(n, width)) @ mixed + draw.normal(size=width) * 3).astype("f4")


def _query(spark, folder, rows):
    shape = "vec_id long, embedding array<float>, label int, n long"
    spark.createDataFrame([(i, v, 0, 7) for i, v in rows], shape).repartition(5).write.parquet(f"{folder}/embeddings.parquet")
    found = QUERIES["op12_embedding_whitening"](spark, str(folder))
    assert tuple(found.columns) == NAMES
    return found.collect()


def _numpy(vectors, k):
    x = np.floor(64 * vectors.astype("f8")).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1], turn[:, ::-1]
    away = [sum(int(d) ** 2 for d in n * row - s) for row in x]
    return away, (centred @ turn / np.sqrt(values))[:, :k], (values / values.sum())[:k]


def _same_to_sign(got, want):
    for c in range(want.shape[1]):
        flip = 1 if got[:, c] @ want[:, c] > 0 else -1
        assert np.allclose(got[:, c], flip * want[:, c], atol=1e-7)


def test_query_against_numpy(spark, tmp_path):
    draw = np.random.default_rng(3)
    vectors = _rows(draw, 700, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [None] + [0.0] * 39), (903, [math.inf] * 40), (904, [math.nan] * 40)]
    found = _query(spark, tmp_path, rows + odd)
    away, white, explained = _numpy(vectors, 32)
    assert len(found) == 700 * 32
    got = np.zeros((700, 32))
    for r in found:
        got[r.vec_id, r.component - 1] = r.whitened
        assert (r.n, r.deviation) == (700, away[r.vec_id])
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
    _same_to_sign(got, white)


def test_repeated_rows_and_null_ids_return_one_by_one(spark, tmp_path):
    draw = np.random.default_rng(5)
    vectors = _rows(draw, 60, 4)
    twice = np.concatenate([vectors, vectors[:1], vectors[:1]])
    found = _query(spark, tmp_path, [(None if i > 60 else i % 60, v.tolist()) for i, v in enumerate(twice)])
    assert len(found) == 62 * 4 and sum(r.vec_id == 0 for r in found) == 8
    assert len({r.whitened for r in found if r.vec_id in (0, None) and r.component == 1}) == 1


@pytest.mark.parametrize("vectors", [[[1.0, 2.0]] * 3, [[1.0, 5.0], [2.0, 5.0], [4.0, 5.0]], [[3.0]]])
def test_components_without_variance_are_null(spark, tmp_path, vectors):
    found = _query(spark, tmp_path, list(enumerate(vectors)))
    live = sum(len({v[d] for v in vectors}) > 1 for d in range(len(vectors[0])))
    assert len(found) == len(vectors) * len(vectors[0])
    for r in found:
        assert (r.whitened is None) == (r.component > live)
        assert (r.identity_error is None) == (live == 0)


def test_empty_table(spark, tmp_path, nothing):
    assert _query(spark, tmp_path, []) == []


def test_blocks_slabs_and_widths(spark, monkeypatch):
    """Several slabs of several blocks give what one gives, rows of other widths take no part."""
    draw = np.random.default_rng(8)
    vectors = _rows(draw, 500, 6)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(1000, [1.0] * 7)]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(7)
    monkeypatch.setattr(whitening, "SLAB_BLOCKS", 5)
    monkeypatch.setattr(whitening, "BLOCKS_IN_TASK", 2)
    found, fit = whitening.whiten(table, k=3)
    assert fit["n"] == 500 and fit["identity_error"] < 1e-9
    got = np.array([r.whitened for r in found.orderBy("vec_id").collect()])
    centred = vectors.astype("f8") - vectors.astype("f8").mean(axis=0)
    values, turn = np.linalg.eigh(centred.T @ centred / 500)
    assert np.allclose(fit["values"], values[::-1])
    _same_to_sign(got, (centred @ turn[:, ::-1] / np.sqrt(values[::-1]))[:, :3])


def test_rows_are_numbered_without_gaps(spark):
    table = spark.range(1000).repartition(13).where("id % 7 <> 0")
    found = sorted(r["_index"] for r in whitening.numbered(table).collect())
    assert found == list(range(len(found)))


def test_deviation_is_exact_or_null(spark):
    rows = [[1_000_000, 1_000_000], [3_000_000_000, 999_999], [-5, 0]]
    table = spark.createDataFrame([(r,) for r in rows], "x array<long>")
    for n in (3, 10**6, 10**12):
        sums = [sum(c) for c in zip(*rows, strict=True)]
        fit = {"n": n, "sums": sums, "least": [-5, 0], "largest": [3_000_000_000, 1_000_000]}
        got = [r.d for r in table.select(whitening.deviation(F.col("x"), fit).alias("d")).collect()]
        want = [sum((n * x - s) ** 2 for x, s in zip(r, sums, strict=True)) for r in rows]
        assert got == [w if w < 1 << 63 else None for w in want]
