import random
import tracemalloc

import numpy as np
import pytest

from corpusloom.llm import batches, bbit, queries


def _set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3)))


def _components(sets):
    """Smallest position that links reach, by comparing all pairs."""
    parent = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = parent[i], parent[j]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    return parent


def _edited(draw, words, share):
    return [f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies():
    """Families of copies at all similarities around the threshold, short texts, empty ones."""
    draw = random.Random(5)
    texts = ["", None, " \t\n", "one two", "ONE  two", "one two three", "one two three four five"]
    for k in range(40):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([6, 12, 40, 150, 400]))]
        for _ in range(6):
            texts.append(" ".join(_edited(draw, base, draw.choice([0, 0.01, 0.02, 0.03, 0.05, 0.08]))))
        cut = draw.randrange(len(base))
        texts += [" ".join(base[cut:]), " ".join(base + base[:cut])]
    return texts


def _table(spark, texts):
    rows = [(i, t, 1.0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, tx double").repartition(3)


@pytest.mark.parametrize(("group", "few"), [(4096, 16), (3, 1)])
def test_components_against_all_pairs(spark, copies, monkeypatch, group, few):
    monkeypatch.setattr(bbit, "GROUP", group)
    monkeypatch.setattr(bbit, "FEW", few)
    monkeypatch.setattr(bbit, "CHUNK", 50)
    sets = [_set(t) for t in copies]
    want = _components(sets)
    found = bbit.near_duplicates(_table(spark, copies)).collect()
    assert len(found) == len(copies)
    for r in found:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), want[r.doc_id]), copies[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    assert len(set(want)) < 0.8 * len(want)


def test_a_band_that_all_share(spark, monkeypatch):
    """A chain of copies, each a little further from the first, and others linked only by the end."""
    monkeypatch.setattr(bbit, "GROUP", 4)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(60):
        base = [f"x{k}" if i == 5 * k else w for i, w in enumerate(base)]
        texts.append(" ".join(base))
    want = _components([_set(t) for t in texts])
    found = {r.doc_id: r.component_id for r in bbit.near_duplicates(_table(spark, texts)).collect()}
    assert [found[i] for i in range(60)] == want == [0] * 60


def test_copies_similar_to_their_origin_only(spark, monkeypatch):
    monkeypatch.setattr(bbit, "GROUP", 16)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for k in range(50):
        # 7 words apart from the origin, 14 from each other
        gone = random.Random(k).sample(range(0, 396, 4), 7)
        texts.append(" ".join(f"x{k}" if i in gone else w for i, w in enumerate(base)))
    texts.insert(23, " ".join(base))
    sets = [_set(t) for t in texts]
    linked = sum(100 * len(a & b) >= 80 * len(a | b) for a in sets for b in sets if a is not b)
    assert linked < 0.4 * 50 * 51
    found = {r.doc_id: r.component_id for r in bbit.near_duplicates(_table(spark, texts)).collect()}
    assert [found[i] for i in range(51)] == _components(sets) == [0] * 51


def test_estimates_are_free_of_chance_matches():
    draw = np.random.default_rng(9)
    factors = draw.integers(0, 1 << 63, bbit.HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    off = []
    for share in (0.0, 0.3, 0.5, 0.8, 0.9, 1.0):
        for _ in range(60):
            n = 300
            both = draw.integers(0, 1 << 63, n, dtype=np.uint64)
            own = round(n * (1 - share) / (1 + share))  # shared over union is ``share``
            other = both.copy()
            other[:own] = draw.integers(0, 1 << 63, own, dtype=np.uint64)
            a, b = (np.frombuffer(bbit.packed(bbit.minima(x, factors)), np.uint64) for x in (both, other))
            off.append(float(bbit.estimate(a[None], b[None])[0]) - (n - own) / (n + own))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04 and np.abs(off).max() < bbit.MARGIN


def test_sets_of_shingles():
    shingles = bbit.Shingles()
    a, b = shingles(b"one two three four five"), shingles(b"TWO\x0bthree  four five")
    assert len(a) == 2 and len(b) == 1 and b[0] in a
    assert len(shingles(b"a b c")) == 1 and shingles(b"a b c")[0] != shingles(b"a b c c")[0]
    assert len(shingles(b"a a a a a a a")) == 1 and len(shingles(b" \n")) == 0
    assert len(shingles("   ".encode())) == 1


def test_odd_rows(spark, docs, texts, nothing):
    want = _components([_set(t) for t in texts])
    found = bbit.near_duplicates(docs).collect()
    assert len(found) == len(texts) + 2
    assert sum(r.doc_id == 0 for r in found) == 2
    for r in found:
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
        else:
            # a copy of text 3
            assert r.component_id == 3 and not r.kept
    assert bbit.near_duplicates(nothing).collect() == []
    only = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    assert {(r.component_id, r.kept) for r in bbit.near_duplicates(only).collect()} == {(None, True)}


def test_a_tile_compares_its_sides_only():
    import pyarrow as pa

    n = 6
    signature = bytes(64)
    columns = {
        "band": [0] * n, "key": [1] * n, "i": [0] * n, "j": [0] * n, "side": [0, 1, 0, 0, 1, 0],
        "node": list(range(n)), "n_shingles": [10, 10, 10, 10, 9, 5], "component": [0, 1, 2, 3, 3, 5],
        "signature": [signature] * n,
    }
    batch = pa.RecordBatch.from_pydict(columns)
    found = bbit._pairs_of_tiles(0.62, 80)(iter([batch]))
    pairs = {(u, v) for b in found for u, v in zip(*(c.to_pylist() for c in b.columns), strict=True)}
    # 5 is too small for 1 and 4; 3 and 4 are of one component
    assert pairs == {(0, 1), (1, 2), (1, 3), (0, 4), (2, 4)}


def test_a_worker_holds_little_at_once():
    """A batch of many texts whose words are all different."""
    import pyarrow as pa

    n = 4000
    texts = [" ".join(f"word{i}x{k}" for k in range(100)) for i in range(n)]
    ids, size = pa.array(range(n), pa.int64()), pa.array(map(len, texts), pa.int32())
    batch = pa.record_batch([ids, ids, size, pa.array(texts)], names=["doc_id", "text_key", "text_size", "text"])
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in bbit._marks(4)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert found == n and most < 12


def test_the_query_sends_few_rows_at_once(spark, docs, tmp_path):
    docs.drop("score").write.parquet(f"{tmp_path}/documents.parquet")
    was, found = spark.conf.get(batches.ROWS_CONF), []
    try:
        for before, after in (("10000", "500"), ("2", "2")):
            spark.conf.set(batches.ROWS_CONF, before)
            rows = queries.QUERIES["op13_bbit_near_duplicates"](spark, str(tmp_path))
            found.append(sorted(map(str, rows.collect())))
            assert spark.conf.get(batches.ROWS_CONF) == after
    finally:
        spark.conf.set(batches.ROWS_CONF, was)
    assert found[0] == found[1] and len(found[0]) == docs.count()
