"""Exact quantiles of skewed columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import aggregates, quantiles

SHARES = {"least": 0.0, "p1": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "p999": 0.999, "most": 1.0}


def _skewed():
    draw = np.random.default_rng(11)
    groups = {
        "crowded": np.exp(draw.normal(0, 4, 3000)),
        "far": np.r_[draw.random(2000), 1e12, -1e12],
        "ties": np.r_[np.full(5000, 2.5), draw.random(40)],
        "same": np.full(300, 7.0),
        "one": np.array([3.25]),
        "two": np.array([1.0, 2.0]),
        "odd": np.array([-0.0, 0.0, np.inf, -np.inf, 5.0, np.inf]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values]
    random.Random(2).shuffle(rows)
    return groups, rows


@pytest.mark.parametrize("leaf", [1, 40, 1 << 16])
def test_quantiles_of_skewed_groups(spark, monkeypatch, leaf):
    monkeypatch.setattr(quantiles, "LEAF", leaf)
    ranked = []
    plain = quantiles._inside
    monkeypatch.setattr(quantiles, "_inside", lambda counted: ranked.append(counted) or plain(counted))
    groups, rows = _skewed()
    df = spark.createDataFrame([*rows, (None, 1.0), ("one", None)], "g string, x double").repartition(5)
    found = {r.g: r for r in aggregates.exact_quantiles(df, "g", ["x"], SHARES).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        with np.errstate(invalid="ignore"):
            want = np.quantile(values, list(SHARES.values()))
        got = [found[g][k] for k in SHARES]
        assert all(a == b or np.isnan(b) or abs(a - b) <= 1e-9 * abs(b) for a, b in zip(got, want, strict=True)), g
    # what is ranked in one task is bounded
    sizes = ranked[-1].groupBy(*quantiles.SPAN).count().agg(F.max("count")).first()[0]
    assert sizes <= leaf


def test_several_metrics_and_a_whole_description(spark):
    draw = np.random.default_rng(3)
    x, y = np.exp(draw.normal(0, 3, 900)), draw.normal(5, 1, 900)
    df = spark.createDataFrame([(i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "is_bs int, x double, y double")
    found = {(r.is_bs, r.metric): r for r in aggregates.describe(df, ["x", "y"]).collect()}
    for g in (0, 1):
        for name, values in (("x", x[g::2]), ("y", y[g::2])):
            r = found[g, name]
            want = [450, values.mean(), values.std(ddof=1), values.min(), *np.quantile(values, [0.25, 0.5, 0.75]), values.max()]
            assert np.allclose([r.n, r.mean, r["std"], r["min"], r.q1, r.median, r.q3, r["max"]], want)


def test_one_row_and_none(spark):
    df = spark.createDataFrame([(1, 2.5)], "is_bs int, x double")
    row = aggregates.describe(df, ["x"]).first()
    assert (row.n, row["std"], row.median) == (1, None, 2.5)
    assert aggregates.describe(df.where("x < 0"), ["x"]).collect() == []
    assert aggregates.box_stats(df.where("x < 0"), "x").collect() == []
    box = aggregates.box_stats(df, "x").first()
    assert (box.q1, box.whisker_low, box.whisker_high, box.n_outliers) == (2.5, 2.5, 2.5, 0)
