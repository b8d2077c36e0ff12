import hashlib

from pyspark.sql import functions as F

from corpusloom.llm import fixity


def _records(spark, n=300):
    rows = [(i // 2, f"d{i}", 100 + i % 7) for i in range(n)] + [(5, "same", 50)] * 9000 + [(None, "none", 10)]
    return fixity.lay_out(spark.createDataFrame(rows, "page_id long, digest string, length long"), ["page_id", "digest"], "length"), rows


def test_offsets_have_no_gaps(spark):
    placed, rows = _records(spark)
    found = sorted((r.offset, r.length) for r in placed.collect())
    at = 0
    for offset, length in found:
        assert offset == at
        at += length
    assert len(found) == len(rows)


def test_finds_exactly_the_faults(spark):
    placed, _ = _records(spark)
    records = placed.select("offset", "length", F.sha2("digest", 256).alias("digest")).cache()
    all_ = sorted(r.offset for r in records.collect())
    bad, lost = {all_[3], all_[5000], all_[-1]}, {all_[77]}
    replica = records.where(~F.col("offset").isin(*lost)).withColumn(
        "digest", F.when(F.col("offset").isin(*bad), "x").otherwise(F.col("digest"))
    )
    extra = replica.unionByName(spark.createDataFrame([(10**9, 5, "y")], "offset long, length long, digest string"))
    found = {r.offset: r.fault for r in fixity.audit_replicas(records, extra, 1 << 12).collect()}
    assert found == {**dict.fromkeys(bad, "damaged"), **dict.fromkeys(lost, "missing"), 10**9: "extra"}
    assert fixity.audit_replicas(records, records).count() == 0


def test_tree_hashes(spark):
    rows = spark.createDataFrame([(0, 5, "a"), (5, 5, "b"), (70_000, 5, "c")], "offset long, length long, digest string")
    tree = fixity.build(rows, 1)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    leaves = {r.node: r.hash for r in tree.levels[0].collect()}
    assert leaves == {0: sha("0:5-a\n5:5-b"), 1: sha("70000:5-c")}
    assert tree.levels[1].first().hash == sha(f"0:{leaves[0]}\n1:{leaves[1]}")


def test_nulls_and_empty(spark):
    rows = spark.createDataFrame([(None, None, None), (1, "u", "")], "page_id long, url string, html string")
    out = [bytes(r[0]) for r in rows.select(fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))).collect()]
    assert all(b"Content-Length: 0\r\n\r\n\r\n\r\n" in r for r in out)
    none = spark.createDataFrame([], "offset long, length long, digest string")
    assert fixity.audit_replicas(none, none).count() == 0
