import hashlib
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from corpusloom import session
from corpusloom.llm import batches, queries, suffixes


def _brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    for d in data:
        covered = np.zeros(len(d), bool)
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                covered[k : k + length] = True
        kept = bytes(np.frombuffer(d, np.uint8)[~covered])
        spans = int((np.diff(np.r_[0, covered.astype(int)]) == 1).sum())
        yield len(d), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()


def _texts(texts):
    part = texts[11][3000:3700]
    return [*texts, "head " + part + " tail", "other " + part[150:640] + " end", part[:450] + texts[3], texts[11][100:560] * 2]


@pytest.mark.parametrize("group", [20_000, 1])
def test_against_brute_force(spark, texts, group, monkeypatch):
    every = _texts(texts)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(every)] + [(None, texts[4])], "doc_id long, text string")
    spans = suffixes.repeated_spans
    monkeypatch.setattr(suffixes, "repeated_spans", lambda d, n: spans(d, n, group=group))
    found = {r.doc_id: tuple(r)[1:5] for r in suffixes.remove_repeats(rows.repartition(4)).collect()}
    want = list(_brute([*every, texts[4]], 400))
    assert found == {**dict(enumerate(want[:-1])), None: want[-1]}


def test_multikey_quicksort():
    draw = np.random.default_rng(4)
    words = draw.integers(0, 3, (3000, 6)).astype(np.uint64)
    order = suffixes.multikey_quicksort(words)
    assert [tuple(r) for r in words[order]] == sorted(map(tuple, words))


def test_equal_strings_have_equal_anchors():
    draw = np.random.default_rng(6)
    part = draw.integers(97, 100, 400).astype(np.uint8)
    for _ in range(20):
        a, b = (np.r_[draw.integers(97, 100, n).astype(np.uint8), part, draw.integers(97, 100, 50).astype(np.uint8)] for n in (37, 210))
        inside = [{p - n for p in suffixes.anchors_of(x, 400, 256).tolist() if n <= p <= n + 256} for x, n in ((a, 37), (b, 210))]
        assert inside[0] & inside[1]


def test_empty_table(nothing):
    assert suffixes.remove_repeats(nothing).count() == 0


def _bucket(n):
    """Surroundings of ``n`` anchors, four of each key, which differ in front or behind."""
    import pyarrow as pa

    raw = np.repeat(np.random.default_rng(3).integers(97, 123, (n // 4, 656)).astype(np.uint8), 4, axis=0)
    raw[::2, :100], raw[1::4, 500:] = 32, 33
    columns = {
        "doc_id": np.arange(n), "tx": np.arange(n), "pos": np.full(n, 300), "alone": np.full(n, True),
        "key": np.repeat(np.arange(n // 4), 4), "ctx": np.arange(n),
        "before": [r[:256].tobytes() for r in raw], "behind": [r[256:].tobytes() for r in raw],
    }
    return pa.record_batch([pa.array(c) for c in columns.values()], names=list(columns))


def _most_held(work, batch):
    """Rows that ``work`` returns, and the bytes it holds at once for each row it gets."""
    tracemalloc.start()
    try:
        found = sum(b.num_rows for b in work(400, 256)(iter([batch])))
        return found, tracemalloc.get_traced_memory()[1] / batch.num_rows
    finally:
        tracemalloc.stop()


def test_a_bucket_takes_little_memory():
    rows, held = _most_held(suffixes._sort_bucket, _bucket(20_000))
    assert rows == 20_000 and held < 3000


def test_strings_of_many_surroundings_take_little_memory():
    rows, held = _most_held(suffixes._all_strings, _bucket(8_000))
    assert rows == 257 * 8_000 and held < 3000


def test_rows_of_equal_leading_bytes_go_to_several_buckets(spark):
    rows = spark.range(4000).selectExpr(
        "id div 4 AS key", "id AS ctx", "CAST('' AS binary) AS before", "CAST(concat(repeat(' ', 40), id div 4) AS binary) AS behind"
    )
    held = suffixes._dealt(rows, 8).selectExpr("spark_partition_id() AS at", "key").groupBy("at", "key").count().collect()
    assert len(held) == 1000 and all(r["count"] == 4 for r in held)
    assert max(Counter(r["at"] for r in held).values()) < 300


def test_small_buckets_and_batches_give_the_same_rows(spark, texts, tmp_path, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(_texts(texts))), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    was, found = spark.conf.get(batches.ROWS_CONF), []
    try:
        for before, after, bucket in (("10000", "500", suffixes.BUCKET), ("2", "2", 4)):
            spark.conf.set(batches.ROWS_CONF, before)
            monkeypatch.setattr(suffixes, "BUCKET", bucket)
            monkeypatch.setattr(suffixes, "SLICE", bucket)
            found.append(sorted(map(str, queries.QUERIES["op2_repeated_strings"](spark, str(tmp_path)).collect())))
            assert spark.conf.get(batches.ROWS_CONF) == after
    finally:
        spark.conf.set(batches.ROWS_CONF, was)
    assert found[0] == found[1] and len(found[0]) == rows.count()


def _shuffle_files(spark):
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    return {f for f in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_with_the_write(spark):
    was = spark.conf.get(session.SHUFFLE_CLEANUP_CONF)
    for keep in (True, False):
        before = _shuffle_files(spark)
        rows = spark.range(3000).selectExpr("id % 700 AS id").groupBy("id").count()
        found = session.materialise(rows, "test-shuffles", keep_shuffles=keep)
        for _ in range(50):
            left = _shuffle_files(spark) - before
            if bool(left) == keep:
                break
            time.sleep(0.2)
        assert bool(left) == keep and found.count() == 700
        assert spark.conf.get(session.SHUFFLE_CLEANUP_CONF) == was


def test_query_marks_documents_that_lose_bytes(spark, tmp_path):
    draw = np.random.default_rng(8)
    # words of five letters behind a space, so 51 of them are 306 bytes and 67 are 402
    words = ["".join(map(chr, w)) for w in draw.integers(97, 123, (2000, 5)).tolist()]
    short, long, own = " ".join(words[:51]), " ".join(words[51:118]), " ".join(words[118:185])
    rest = [" ".join(words[k : k + 100]) for k in range(200, 1200, 100)]
    every = [
        f"{rest[0]} {short} {rest[1]}", f"{rest[2]} {short} {rest[3]}", f"{rest[4]} {long} {rest[5]}",
        f"{rest[6]} {long}", f"{own} {rest[7]} {own}", rest[8], "", None,
    ]
    rows = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    was = spark.conf.get(batches.ROWS_CONF)
    try:
        found = queries.QUERIES["op2_repeated_strings"](spark, str(tmp_path))
        assert found.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        marked = {r.doc_id: r.repeated for r in found.collect()}
    finally:
        spark.conf.set(batches.ROWS_CONF, was)
    # 51 words that two documents share are no string of 400 bytes
    assert marked == {0: False, 1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False}
    assert marked == {i: b[1] > 0 for i, b in enumerate(_brute(every, 400))}
