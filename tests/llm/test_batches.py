import corpus_pipeline
import pyarrow as pa
import pytest

from corpusloom.llm import batches, packing, simhash


def test_parts_are_small_and_whole():
    texts = ["x" * 2000] * 3000 + [None, "", "y" * 3_000_000, "z"]
    whole = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    found = list(batches.parts([whole, whole.slice(0, 0), whole.slice(5, 1)]))
    assert sum(b.num_rows for b in found) == len(texts) + 1 and any(b.num_rows == 0 for b in found)
    assert [i for b in found for i in b.column(0).to_pylist()] == [*range(len(texts)), 5]
    assert max(len(b) for b in found) * whole.nbytes / len(texts) <= batches.PART_BYTES


@pytest.mark.parametrize("stage", ["toxicity", "simhash_near_dedup", "packing"])
def test_stages_send_few_rows_at_once(spark, stage, docs):
    was = spark.conf.get(batches.ROWS_CONF)
    sf = "/root/testdata/sf0.001"
    try:
        for before, after in (("10000", "500"), ("0", "500"), ("20", "20")):
            spark.conf.set(batches.ROWS_CONF, before)
            dict(corpus_pipeline.STAGES)[stage](spark, docs.drop("score").limit(4), sf)
            assert spark.conf.get(batches.ROWS_CONF) == after
    finally:
        spark.conf.set(batches.ROWS_CONF, was)


def test_rows_do_not_depend_on_batches(spark, docs):
    was, found = spark.conf.get(batches.ROWS_CONF), []
    try:
        for rows in ("10000", "2"):
            spark.conf.set(batches.ROWS_CONF, rows)
            found.append((
                sorted(map(str, simhash.near_duplicates(docs).collect())),
                sorted(str(r[:5]) for r in packing.pack(docs).collect()),
            ))
    finally:
        spark.conf.set(batches.ROWS_CONF, was)
    assert found[0] == found[1]
