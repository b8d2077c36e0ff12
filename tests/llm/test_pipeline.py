import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_drop_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert docs.columns == columns and len(now) == len(set(now)) and set(now) <= ids, name
        ids = set(now)
    assert ids


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(0 < r.length <= 1024 for r in rows)


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii_surrogates", "packing"]
