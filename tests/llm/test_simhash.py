import numpy as np
import xxhash

from corpusloom.llm import simhash
from corpusloom.llm.components import connected


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(runs))


def _reach(n, linked):
    parent = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    return parent


def test_fingerprints_and_components_against_brute_force(docs, texts):
    found = simhash.near_duplicates(docs).collect()
    fps = [_fingerprint(t) for t in texts]
    root = _reach(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    assert len(found) == len(texts) + 2
    for r in found:
        if r.doc_id is not None:
            assert r.fp % (1 << 64) == fps[r.doc_id] and r.component_id == root[r.doc_id]
        else:
            assert r.component_id == root[3]


def test_links_find_all_chains_also_in_dealt_out_keys(spark):
    draw = np.random.default_rng(5)
    base = draw.integers(0, 1 << 62, 30, dtype=np.uint64)
    fps = []
    for b in base:
        for _ in range(20):
            flips = draw.choice(64, draw.integers(0, 4), replace=False)
            fps.append(int(b) ^ sum(1 << int(f) for f in flips))
    fps = sorted(set(fps))
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame(rows, "fp long, rep long")
    want = _reach(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    for group in (4096, 3):
        edges = simhash.links(distinct, group)
        got = dict(connected(edges).select("node", "component").collect())
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_bit_sliced_distances():
    draw = np.random.default_rng(1)
    fps = draw.integers(0, 1 << 63, 64, dtype=np.uint64)
    fps[1::2] = fps[::2] ^ np.uint64(0b1011)
    planes = np.array([[sum(int(f >> np.uint64(b) & np.uint64(1)) << i for i, f in enumerate(fps))] for b in range(64)], np.uint64)
    for radius in (3, 22, 31):
        near = simhash.within(fps, planes, np.zeros(64, int), np.arange(64), radius)
        for i in range(64):
            for k in range(64):
                assert (int(near[i]) >> k & 1) == (bin(int(fps[i] ^ fps[k])).count("1") <= radius)


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0
    assert simhash.keep_one(nothing).count() == 0


def test_keep_one_of_each_group(docs, texts):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    fps = [_fingerprint(t) for t in texts]
    root = _reach(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    # the second row of id 0 is a copy of the first, the row without an id one of text 3
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_keep_one_of_rows_without_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (None, "other words are here"), (7, "x y z"), (7, "x y z")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.text for r in kept)) == sorted({t for _, t in rows})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (None, 5)], "u long, v long")
    assert {tuple(r) for r in connected(edges).collect()} == {(i, 0) for i in range(61)}
