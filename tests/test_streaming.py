from pyspark.sql import functions as F

from corpusloom.sources import files
from corpusloom.streaming import sample as st

SCHEMA = "page_id long, url string"


def write_batch(spark, folder, start, hosts):
    rows = [(start + i, f"http://{h}/p") for i, h in enumerate(hosts)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def stream(spark, folder):
    return files.read_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema)


def drain(spark, folder, path, checkpoint, hosts, n):
    query = st.start_to_parquet(
        st.capped_sample(st.filter_hosts(stream(spark, folder), hosts), n), path, checkpoint
    )
    query.awaitTermination()
    return query


def test_cap_holds_over_batches_and_restarts(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    write_batch(spark, folder, 0, ["a.com", "a.com", "b.org", "other.net"])
    write_batch(spark, folder, 10, ["A.com"] * 5 + ["b.org"])
    drain(spark, folder, path, checkpoint, ["a.com", "b.org"], 3)
    first = spark.read.parquet(path)
    assert {r["host"]: r["count"] for r in first.groupBy("host").count().collect()} == {
        "a.com": 3, "b.org": 2,
    }
    # a.com is full now, b.org takes one more after a restart
    write_batch(spark, folder, 20, ["a.com", "b.org", "b.org"])
    drain(spark, folder, path, checkpoint, ["a.com", "b.org"], 3)
    got = sorted((r["host"], r["page_id"]) for r in spark.read.parquet(path).collect())
    assert [h for h, _ in got] == ["a.com"] * 3 + ["b.org"] * 3
    assert ("b.org", 21) in got and ("b.org", 22) not in got


def test_order_within_one_batch(spark, tmp_path):
    folder, path, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    rows = [(i, "http://a.com/") for i in (9, 3, 7, 1, 5)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder))
    drain(spark, folder, path, checkpoint, ["a.com"], 2)
    assert sorted(r["page_id"] for r in spark.read.parquet(path).collect()) == [1, 3]


def test_stops_when_full(spark, tmp_path):
    folder = tmp_path / "in"
    for b in range(4):
        write_batch(spark, folder, b * 10, ["a.com", "b.org"])
    got = st.collect_until_full(
        stream(spark, folder), ["a.com", "b.org"], 1, str(tmp_path / "out"), str(tmp_path / "st"),
        poll_seconds=0.2, available_now=False,
    )
    assert {r["host"]: r["count"] for r in got.groupBy("host").count().collect()} == {"a.com": 1, "b.org": 1}
    assert not spark.streams.active


def test_labels_equal_batch(spark, tmp_path):
    folder = tmp_path / "in"
    write_batch(spark, folder, 0, ["a.com", "b.org", "c.net"])
    write_batch(spark, folder, 5, ["a.com"])
    labelled = st.label_stream(stream(spark, folder), ["a.com"], ["b.org"])
    st.start_to_parquet(labelled, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = st.label_stream(spark.read.parquet(str(folder)), ["a.com"], ["b.org"])
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(
        map(str, batch.collect())
    )


def test_progress_of_more_than_a_hundred_batches_over_a_restart(spark, tmp_path):
    """Spark itself remembers the last hundred batches of a running query only."""
    folder, out = tmp_path / "in", [str(tmp_path / x) for x in ("out", "counts", "state")]
    for first, last in ((0, 70), (70, 112)):
        rows = [(i, f"http://h{i % 3}.com/p") for i in range(first * 2, last * 2)]
        parts = spark.createDataFrame(rows, SCHEMA).repartitionByRange(last - first, "page_id")
        parts.write.mode("append").parquet(str(folder))
        hosted = stream(spark, folder).withColumn("host", F.split_part("url", F.lit("/"), F.lit(3)))
        query = st.start_with_progress(hosted, *out)
        query.awaitTermination()
        assert len(query.recentProgress) <= 100
    table = st.progress_table(spark, out[1]).orderBy("batch").collect()
    assert [r.batch for r in table] == list(range(112))
    assert table[-1].n_seen == 224 and [r.n_seen for r in table] == [sum(x.n_rows for x in table[: i + 1]) for i in range(112)]
    counts = {r.host: r.n_rows for r in st.progress_counts(spark, out[1], ["h0.com", "h1.com", "H2.com", "none.com"]).collect()}
    assert counts == {"h0.com": 75, "h1.com": 75, "h2.com": 74, "none.com": 0}
    assert st.collected(spark, out[0], hosted.schema).select("page_id").distinct().count() == 224


def test_a_batch_that_is_tried_again_writes_over_itself(spark, tmp_path):
    folder, out, counts, state = (str(tmp_path / x) for x in ("in", "out", "counts", "state"))
    for k in range(3):
        write_batch(spark, folder, 10 * k, ["a.com", "b.org"])
    hosted = stream(spark, folder).withColumn("host", F.split_part("url", F.lit("/"), F.lit(3)))
    st.start_with_progress(hosted, out, counts, state).awaitTermination()
    # as if the driver was lost behind the writes of the last batch and before its commit
    for name in ("2", ".2.crc"):
        (tmp_path / "state" / "commits" / name).unlink(missing_ok=True)
    st.start_with_progress(hosted, out, counts, state).awaitTermination()
    assert st.collected(spark, out, hosted.schema).count() == 6
    assert [r.n_seen for r in st.progress_table(spark, counts).orderBy("batch").collect()] == [2, 4, 6]


def test_no_input_at_all(spark, tmp_path):
    (tmp_path / "in").mkdir()
    got = st.collect_until_full(stream(spark, tmp_path / "in"), ["a.com"], 1, str(tmp_path / "o"), str(tmp_path / "s"))
    assert got.collect() == [] and st.progress_table(spark, str(tmp_path / "o-progress")).collect() == []


def test_queries_stream_over_a_table_that_is_a_folder(spark, tmp_path):
    from corpusloom.suite import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    one = QUERIES["s07_stream_source"](spark, "/root/testdata/sf0.001")
    many = QUERIES["s07_stream_source"](spark, str(tmp_path))
    assert sorted(many.collect()) == sorted(one.collect()) and many.count() > 0
