import numpy as np

from corpusloom.llm import crosspolytope


def test_neighbours_against_brute_force(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(600, 32)) * draw.uniform(0.5, 2, (600, 1))
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (701, [0.0] * 32), (702, [float("nan")] * 32), (703, [float("inf")] * 32), (None, x[0].tolist()), (704, [None] * 32)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 20 = 0 OR vec_id IS NULL")
    for probes, least in ((64, 0.97), (14, 0.85)):
        by_query, hits = {}, []
        for r in crosspolytope.search(table, asked, probes=probes).orderBy("query_id", "rank").collect():
            by_query.setdefault(r.query_id, []).append(r)
        assert sorted(by_query) == list(range(0, 600, 20))
        for q, found in by_query.items():
            score = x @ x[q]
            score[q] = -np.inf
            best = sorted(range(600), key=lambda i: (-score[i], i))[:20]
            hits.append(len({r.vec_id for r in found} & set(best)) / 20)
            assert [r.rank for r in found] == list(range(1, len(found) + 1))
            assert all(abs(r.score - x[q] @ x[r.vec_id]) < 1e-9 for r in found)
            keys = [(-r.score, r.vec_id) for r in found]
            assert keys == sorted(keys) and q not in {r.vec_id for r in found}
        assert np.mean(hits) >= least


def test_blocks_change_nothing_and_ties_go_to_smaller_ids(spark, monkeypatch):
    draw = np.random.default_rng(3)
    one = (draw.normal(size=16)).tolist()
    rows = [(i, one) for i in range(50)] + [(i, draw.normal(size=16).tolist()) for i in range(50, 90)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = table.where("vec_id % 20 = 0")
    want = sorted(crosspolytope.search(table, asked, nearest=5).collect())
    assert [r.vec_id for r in want if r.query_id == 0] == [1, 2, 3, 4, 5]
    monkeypatch.setattr(crosspolytope, "BLOCK", 7)
    monkeypatch.setattr(crosspolytope, "QUERY_BLOCK", 2)
    assert sorted(crosspolytope.search(table, asked, nearest=5).collect()) == want


def test_few_and_no_rows(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    two = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<float>")
    assert crosspolytope.search(empty, empty).count() == 0
    assert crosspolytope.search(two, two.where("vec_id % 20 = 0"), probes=8).count() == 2


def test_hadamard_is_a_rotation():
    y = crosspolytope.hadamard(np.eye(16))
    assert np.allclose(y @ y.T, np.eye(16))


def test_recall_at_production_parameters_on_unequal_norms(spark):
    draw = np.random.default_rng(5)
    unit = draw.normal(size=(3000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    one_long = np.ones(3000)
    one_long[17] = 50
    for norms in (one_long, draw.uniform(0.5, 2, 3000), np.exp(draw.normal(size=3000))):
        x = unit * norms[:, None]
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        found: dict = {}
        for r in crosspolytope.search(table, table.where("vec_id % 30 = 0")).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        hits = []
        for q in range(0, 3000, 30):
            score = x @ x[q]
            score[q] = -np.inf
            hits.append(len(found[q] & set(np.argsort(-score)[:20].tolist())) / 20)
            assert len(found[q]) == 20
        assert np.mean(hits) >= 0.9


def test_queries_with_few_finds_are_compared_with_all(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(60, 64))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = crosspolytope.search(table, table.where("vec_id % 20 = 0"), tables=1, probes=1).collect()
    for q in (0, 20, 40):
        score = x @ x[q]
        score[q] = -np.inf
        assert [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] == np.argsort(-score)[:20].tolist()
