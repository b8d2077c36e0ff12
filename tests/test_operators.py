import pytest
from pyspark.sql import functions as F

from corpusloom.operators import aggregates, evaluation, filters, joins, unions, windows
from corpusloom.schemas import CORPUS


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_unattributed_negatives(spark):
    df = spark.createDataFrame(
        [(1, "A (Reuters) - x", 0), (2, "tweet", 0), (3, "tweet", 1), (4, "A (Reuters)- x", 0)],
        "row_id long, text string, is_bs int",
    )
    kept = filters.drop_unattributed_negatives(df)
    assert rows(kept, "row_id") == [(1,), (3,)]
    bad = df.filter(filters.is_unattributed_negative()).select("row_id")
    assert rows(joins.drop_rows(df, bad), "row_id") == [(1,), (3,)]


def test_length_bounds(spark):
    df = spark.createDataFrame(
        [(n, "a" * n) for n in (200, 201)] + [(0, None)], "n int, text string"
    )
    assert rows(filters.longer_than(df), "n") == [(201,)]
    words = spark.createDataFrame(
        [(n, "w " * n) for n in (1, 2, 3, 4)] + [(0, None)], "n int, text string"
    )
    assert rows(filters.words_between(words, 2, 3), "n") == [(2,), (3,)]
    with pytest.raises(ValueError):
        filters.words_between(words, 2)


def test_blank_and_labels(spark):
    df = spark.createDataFrame([("a", 0), ("  ", 1), (None, 1), ("b", 7)], "text string, labels int")
    clean = filters.drop_blank(df)
    assert rows(clean, "text") == [("a",), ("b",)]
    assert rows(filters.label_violations(clean), "label", "n_rows") == [(7, 1)]
    with pytest.raises(Exception, match="label out of domain"):
        filters.enforce_labels(clean).collect()
    named = filters.enforce_labels(clean.filter("labels = 0"), names=["no", "yes"], name_col="n")
    assert named.first()["n"] == "no"


def test_drop_and_missing_columns(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert filters.drop_columns(df, "b", "zzz").columns == ["a"]
    with pytest.raises(ValueError):
        filters.keep(df, "a", "zzz")


def test_hosts(spark):
    df = spark.createDataFrame(
        [(1, "http://A.com/x"), (2, "junk"), (3, None), (4, "https://b.org:8080/"), (5, "http://c.net")],
        "page_id long, url string",
    )
    assert rows(filters.host_in(df, ["https://a.com", "b.org:8080"]), "page_id") == [(1,), (4,)]
    table = spark.createDataFrame([("A.com",)], "host string")
    assert rows(filters.host_in(df, table), "page_id") == [(1,)]
    labelled = joins.label_by_host(df, ["a.com"], ["a.com", "b.org:8080"])
    assert rows(labelled.fillna({"is_bs": -1}), "page_id", "is_bs") == [
        (1, 1), (2, -1), (3, -1), (4, 0), (5, -1),
    ]
    counted = aggregates.rows_per_host(df, ["a.com", "none.example"])
    assert rows(counted, "host", "n_rows") == [("a.com", 1), ("none.example", 0)]


def test_aliases(spark):
    df = spark.createDataFrame(
        [
            (1, "x", "met Ann and ann"),
            (2, "x", "Annabel only"),
            (3, "x", "J.R. wrote"),
            (4, "x", "JxR. wrote"),
            (5, "y", "Ann again"),
            (6, None, "Ann"),
        ],
        "row_id long, who string, text string",
    )
    aliases = {"x": ["Ann", "J.R"], "z": ["q"]}
    hits = aggregates.alias_leakage(df, aliases, "text", "who")
    assert rows(hits, "label", "n_hits") == [("x", 2)]


def test_alias_table_finds_what_the_pattern_finds(spark):
    names = ["Ann", "J.R", "'s", "...", "de la", "de", "La", "é", "x_1", "a-b", "(q)", "-", " of the", "ann  lee"]
    parts = [*names, "annabel", " ", "  ", "-", ".", "É", "_", "ANN Lee", "de  la", "x"]
    texts = [
        "".join(parts[(i * k + i // 7 * j) % len(parts)] + (" " if (i + j) % 3 else "") for j, k in enumerate((1, 3, 5, 7, 11)))
        for i in range(400)
    ]
    rows_ = [(i, i % 2, text) for i, text in enumerate(texts)] + [(900, 0, ""), (901, 0, None), (902, None, "ann")]
    df = spark.createDataFrame([*rows_, (903, 1, "..."), (904, 1, "x" * 100_000 + " ann")], "row_id long, is_bs int, text string")
    by_label = {0: names[:9], 1: names[6:] + ["ann"]}
    table = [(label, name) for label, of in by_label.items() for name in of]
    aliases = spark.createDataFrame([*table, table[0], (0, None), (None, "x"), (1, "")], "label long, alias string")
    expected = rows(df.filter(joins.mentions_own_alias(F.col("text"), F.col("is_bs"), by_label)), "row_id")
    for bound in (100, 0):
        hits = joins.own_alias_hits(df, aliases, max_keys=bound)
        assert rows(hits, "row_id") == expected and 100 < len(expected) < 400
    counts = rows(aggregates.alias_table_leakage(df, aliases), "label", "n_hits")
    assert counts == rows(aggregates.alias_leakage(df, by_label), "label", "n_hits")
    assert joins.own_alias_hits(df, aliases.limit(0)).count() == 0
    assert joins.own_alias_hits(df.limit(0), aliases).count() == 0


def test_alias_table_takes_the_leftmost_then_longest(spark):
    texts = [(1, 0, "- El de la Rosa, Ann"), (2, 0, "la ann"), (3, 0, "\U0001d4d0ann")]
    df = spark.createDataFrame(texts, "row_id long, is_bs int, text string")
    aliases = spark.createDataFrame([(0, a) for a in ("Ann", "de", "DE LA", "la rosa", "rosa")], "label int, alias string")
    got = joins.own_alias_hits(df, aliases)
    assert rows(got, "row_id", "place", "alias") == [(1, 3, "de la"), (2, 3, "ann")]


def test_topic_summary_one_class(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 0), (None, 0)], "topic int, is_bs int")
    got = aggregates.topic_label_summary(df)
    assert rows(got, "topic", "n_label_1", "total", "fake_ratio") == [(1, 0, 2, 0.0), (2, 0, 1, 0.0)]


def test_majority_tie(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "topic int, is_bs int")
    assert rows(aggregates.majority_label(df), "topic", "topic_pred") == [(1, 0), (2, 1)]


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (0.5,)], "x double")
    assert rows(aggregates.histogram(df, "x"), "bin", "n_rows") == [(1, 1), (11, 1), (20, 1)]
    flat = spark.createDataFrame([(0.5,), (0.5,)], "x double")
    assert rows(aggregates.histogram(flat, "x"), "bin", "n_rows") == [(11, 2)]


def test_exact_quantiles_match_percentile(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("g"),
        # a group with ties, one far outlier and a wide spread
        F.when(F.col("id") == 7, 1e9).otherwise(F.round(F.rand(1) * 50, 2)).alias("x"),
        F.when(F.col("id") % 7 != 0, F.rand(2)).alias("y"),
        F.lit(3.25).alias("z"),
    ).cache()
    want = []
    for m in ("x", "y", "z"):
        part = df.groupBy("g").agg(F.percentile(m, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
        want += [(r["g"], m, *[round(v, 9) for v in r["q"]]) for r in part.collect()]
    got = aggregates.exact_quantiles(df, "g", ["x", "y", "z"], aggregates.QUARTILES)
    assert sorted(want) == sorted(
        (r["g"], r["metric"], *[round(r[k], 9) for k in ("q1", "median", "q3")]) for r in got.collect()
    )


def test_describe_approximate_runs(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("is_bs"), F.col("id").cast("double").alias("x"))
    exact = aggregates.describe(df, ["x"]).orderBy("is_bs").collect()
    near = aggregates.describe(df, ["x"], approximate=True).orderBy("is_bs").collect()
    assert [r["n"] for r in exact] == [50, 50]
    assert abs(exact[0]["median"] - near[0]["median"]) <= 2


def test_report_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (1, 0), (2, 0)], "a int, p int")
    got = {r["name"]: r for r in evaluation.classification_report(df, "a", "p").collect()}
    assert got["1"]["precision"] == 0 and got["1"]["recall"] == 0 and got["1"]["support"] == 1
    assert got["accuracy"]["precision"] == 0.33 and got["accuracy"]["support"] == 3
    perfect = spark.createDataFrame([(0, 0), (1, 1)], "a int, p int")
    assert {r["f1"] for r in evaluation.classification_report(perfect, "a", "p").collect()} == {1.0}


def test_logit_metrics_extremes(spark):
    df = spark.createDataFrame([([1000.0, 0.0], 0), ([1000.0, 0.0], 1)], "logits array<double>, labels int")
    row = evaluation.logit_metrics(df).first()
    assert row["accuracy"] == 0.5 and 17 < row["log_loss"] < 19


def test_keep_first(spark):
    df = spark.createDataFrame(
        [(5, "a", 1), (2, "a", 0), (3, None, 1), (4, None, 0), (1, "b", 1)],
        "row_id long, text string, is_bs int",
    )
    assert rows(windows.keep_first(df), "row_id") == [(1,), (2,), (3,)]
    assert aggregates.duplicate_count(df).first()[0] == 2
    spread = windows.keep_first(df.repartition(7))
    assert rows(spread, "row_id") == [(1,), (2,), (3,)]


def test_first_n_hot_origin(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("o")
    )
    kept = windows.first_n(df, "o", 4)
    want = {}
    for r in df.orderBy("row_id").collect():
        want.setdefault(r["o"], [])
        if len(want[r["o"]]) < 4:
            want[r["o"]].append(r["row_id"])
    assert rows(kept, "o", "row_id") == sorted((o, i) for o, ids in want.items() for i in ids)


def test_shuffle_positions(spark):
    df = spark.range(500).withColumnRenamed("id", "row_id")
    got = windows.shuffled(df).orderBy("shuffle_pos").collect()
    assert [r["shuffle_pos"] for r in got] == list(range(500))
    again = windows.shuffled(df.repartition(5)).orderBy("shuffle_pos").collect()
    assert [r["row_id"] for r in got] == [r["row_id"] for r in again] != list(range(500))


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "row_id long, text string")
    b = spark.createDataFrame([("y", 5)], "text string, extra int")
    assert rows(unions.union_all(a, b).fillna({"row_id": 0, "extra": 0}), "row_id", "text", "extra") == [
        (0, "y", 5), (1, "x", 0),
    ]
    assert rows(unions.labelled_union(b, b), "text", "is_bs") == [("y", 0), ("y", 1)]
    empty, failed = unions.union_available(spark, {"gone": lambda: spark.read.parquet("/no/such")}, CORPUS)
    assert empty.count() == 0 and empty.schema == CORPUS and "gone" in failed


def test_best_run_patience(spark):
    scores = [0.1, 0.3, 0.2, 0.3, 0.9]
    df = spark.createDataFrame([("r", i, s) for i, s in enumerate(scores)], "run string, step int, f1_macro double")
    row = evaluation.best_run(df).first()
    assert (row["best_step"], row["best_f1_macro"], row["last_step"]) == (1, 0.3, 3)


def test_first_n_with_ties(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 2, "x"), ("b", None, "y")]
    df = spark.createDataFrame(rows, "origin string, row_id long, text string")
    got = windows.first_n(df, "origin", 1).collect()
    assert sorted(r["origin"] for r in got) == ["a", "b"]


def test_union_loses_only_the_source_that_fails_while_it_is_read(spark, tmp_path):
    from pyspark.sql import types as T

    good = spark.range(10).select("id", F.col("id").cast("string").alias("label"))
    good.write.parquet(str(tmp_path / "good"))
    good.repartition(3).write.parquet(str(tmp_path / "corrupt"))
    broken = sorted((tmp_path / "corrupt").glob("part-*.parquet"))[1]
    broken.write_bytes(broken.read_bytes()[:-200] + bytes(200))
    schema = T.StructType().add("id", T.LongType()).add("label", T.IntegerType()).add("more", T.StringType())
    read = lambda name: lambda: spark.read.schema("id long, label string").parquet(str(tmp_path / name))

    @F.udf("string")
    def fails(x):
        raise RuntimeError("no such page")

    inputs = {
        "good": read("good"),
        "corrupt": read("corrupt"),
        "gone": lambda: spark.read.parquet(str(tmp_path / "gone")),
        "no number": good.withColumn("label", F.lit("many")),
        "failing": good.withColumn("label", fails("label")),
        "none": None,
        "empty": good.limit(0),
        "again": good,
    }
    merged, audit = unions.union_committed(spark, inputs, schema)
    assert merged.schema == schema and sorted(r.id for r in merged.collect()) == sorted([*range(10)] * 2)
    rows = {r.step: r for r in audit.collect()}
    assert list(rows) == list(inputs)
    assert {k: r.rows_out for k, r in rows.items() if r.error is None} == {"good": 10, "empty": 0, "again": 10}
    assert all(rows[k].rows_out == 0 and rows[k].error for k in ("corrupt", "gone", "no number", "failing", "none"))
    nothing, audit = unions.union_committed(spark, {"gone": inputs["gone"]}, schema)
    assert nothing.collect() == [] and nothing.schema == schema and audit.count() == 1
