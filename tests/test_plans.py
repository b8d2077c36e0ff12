import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import bounded
from corpusloom.functions import entities as ent
from corpusloom.functions import keys, lexical
from corpusloom.functions import text as tx
from corpusloom.models import baseline, topics, vectors, wide
from corpusloom.operators import aggregates, filters, joins, sampling, windows
from corpusloom.plans import eda, prepare, process
from corpusloom.session import spread, work_root
from corpusloom.suite import ORACLES, QUERIES
from corpusloom.suite.registry import Tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def plan(df):
    return df._jdf.queryExecution().toString()


def test_native_expressions_use_no_python(t):
    text = F.col("text")
    df = t.documents.select(
        tx.repair_text(text), tx.word_count(text), keys.text_seed(text), lexical.hdd(text),
        ent.mask_entities(text, ent.tag_entities(text, {"A": "PER"})), baseline.terms(text),
    )
    shown = plan(df)
    assert "EvalPython" not in shown and "Exchange" not in shown


def test_narrow_scans_and_pushed_filters(t):
    shown = plan(filters.in_categories(t.documents, "lang", ["en"]).select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in shown and "In(lang" in shown or "EqualTo(lang" in shown
    assert "text" not in plan(aggregates.value_counts(t.documents, "lang")).split("Physical Plan")[1]


def test_small_sides_are_broadcast_after_a_check(t):
    topics_ = aggregates.topic_label_summary(t.corpus).select("topic")
    assert "BroadcastHashJoin" in plan(joins.keep_keys(t.corpus, topics_, "topic"))
    assert bounded.small_rows(t.documents.select("doc_id"), max_rows=10) is None
    same = bounded.checked(t.documents.select("doc_id"), max_rows=10)
    assert same.count() == t.documents.count()


def test_joins_beyond_the_bound_give_the_same_rows(t, monkeypatch):
    def run():
        return [
            sorted(map(str, df.collect()))
            for df in (
                sampling.topic_parity(t.corpus, 3).select("row_id"),
                sampling.balanced_sample(t.corpus, ["is_bs"], 10).select("row_id"),
                sampling.stratified_split(t.corpus, 0.9, 0.1, ["is_bs"]).select("row_id", "split"),
                windows.first_n(t.documents, "source", 2, "doc_id").select("doc_id"),
                aggregates.group_size_on_rows(t.corpus.select("row_id", "is_bs", "text")),
            )
        ]

    small = run()
    monkeypatch.setattr(bounded, "small_rows", lambda *a, **k: None)
    monkeypatch.setattr(sampling, "small_rows", lambda *a, **k: None)
    assert run() == small


def test_sampling_does_not_shuffle_the_text(t):
    split = sampling.stratified_split(t.documents.select(F.col("doc_id").alias("row_id"), "text"))
    shown = plan(split).split("Physical Plan")[1]
    assert "Exchange hashpartitioning" not in shown and "Window" not in shown


def test_spread_only_small_inputs(t, spark):
    assert spread(t.documents, "doc_id").rdd.getNumPartitions() == 16
    many = spark.range(0, 1000, 1, 64)
    assert spread(many).rdd.getNumPartitions() == 64


def test_work_root_is_the_session_folder(spark):
    assert work_root(spark) == work_root(spark)

    class Named:
        class conf:
            get = staticmethod(lambda key, default: {"spark.checkpoint.dir": "/shared/x"}[key])

    assert work_root(Named) == "/shared/x"

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_root(Cluster)


def test_tokens_fixed_length(spark, monkeypatch):
    df = spark.createDataFrame([(1, "b a a"), (2, "x " * 70), (3, "")], "row_id long, text string")
    vocab = prepare.token_vocabulary(df, size=2)
    assert [tuple(r) for r in vocab.orderBy("token_id").collect()] == [("x", 2), ("a", 3)]
    got = {r["row_id"]: r for r in prepare.encode(df, vocab).collect()}
    monkeypatch.setattr(prepare, "small_rows", lambda _df: None)
    assert {r["row_id"]: r for r in prepare.encode(df, vocab).collect()} == got
    assert all(len(r["input_ids"]) == len(r["attention_mask"]) == 64 for r in got.values())
    assert got[1]["input_ids"][:4] == [1, 3, 3, 0] and sum(got[2]["attention_mask"]) == 64
    assert sum(got[3]["attention_mask"]) == 0


def test_reduced_vectors_are_ordered_and_centred(t):
    v = vectors.as_vector(t.embeddings, "embedding")
    reduced = vectors.components(vectors.reduce_dimensions(v, 150))
    wide = reduced.select(F.size("reduced").alias("n")).first()["n"]
    assert wide == 64
    var = [
        r["v"] for r in reduced.select(F.posexplode("reduced").alias("i", "x"))
        .groupBy("i").agg(F.var_samp("x").alias("v")).orderBy("i").collect()
    ]
    assert var == sorted(var, reverse=True)


def test_wide_reduction_equals_the_exact_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((300, 40)) * np.linspace(6, 0.2, 40) ** 2 + 5
    data[rng.random(data.shape) < 0.3] = 0
    rows = [(i, Vectors.sparse(40, list(np.flatnonzero(r)), r[r != 0]) if i % 2 else Vectors.dense(r)) for i, r in enumerate(data)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vector", VectorUDT())])
    df = spark.createDataFrame([*rows, (300, Vectors.sparse(40, [], [])), (301, Vectors.dense(data[0]))], schema)
    exact = np.array([r["reduced"] for r in vectors.reduce_dimensions(df, 3).orderBy("id").collect()])
    monkeypatch.setattr(vectors, "MAX_PCA_WIDTH", 39)
    got = np.array([r["reduced"] for r in vectors.reduce_dimensions(df, 3).orderBy("id").collect()])
    assert np.allclose(abs(got), abs(exact), atol=1e-3)
    _, variances, passes = wide.principal_directions(df, 3)
    assert np.allclose(variances, exact.var(axis=0, ddof=1)) and passes < 30
    nulls = spark.createDataFrame([*rows, (400, None)], schema)
    assert [r["reduced"] is None for r in vectors.reduce_dimensions(nulls, 2).orderBy("id").collect()].count(True) == 1


def test_wide_reduction_of_sparse_vectors_of_width_20000(spark):
    rng = np.random.default_rng(4)
    # two planted directions on columns of their own, and little noise elsewhere
    drawn = rng.standard_normal((200, 2))
    strong, rows = np.linalg.qr(drawn - drawn.mean(axis=0))[0] * [120, 50], []
    for i, (a, b) in enumerate(strong):
        rest = np.unique(rng.integers(4, 20_000, 20))
        rows.append((i, Vectors.sparse(20_000, [0, 1, 2, 3, *rest], [a, -a, b, b, *rng.random(len(rest)) * 0.1])))
    directions, variances, passes = wide.principal_directions(spark.createDataFrame(rows, ["id", "vector"]), 2)
    planted = np.zeros((20_000, 2))
    planted[[0, 1], 0], planted[[2, 3], 1] = [0.5**0.5, -(0.5**0.5)], 0.5**0.5
    assert np.allclose(abs((directions * planted).sum(axis=0)), 1, atol=1e-3) and passes <= 6
    assert np.allclose(variances, strong.var(axis=0, ddof=1) * 2, rtol=0.05)
    with pytest.raises(ValueError, match="exceed"):
        wide.principal_directions(spark.createDataFrame(rows[:2], ["id", "vector"]), 20_000)


def test_topics_cover_all_rows(t):
    docs = t.documents.select(F.col("doc_id").alias("row_id"), "text")
    got = topics.assign_topics(docs, n_topics=4, min_cluster_size=20).groupBy("topic").count().collect()
    sizes = {r["topic"]: r["count"] for r in got}
    assert sum(sizes.values()) == docs.count() and -1 in sizes
    real = [sizes[k] for k in sorted(sizes) if k >= 0]
    assert real == sorted(real, reverse=True) and min(real) >= 20


def test_exact_quantile_against_a_sort(spark):
    values = [float((i * 7919) % 1000) ** 3 for i in range(1000)] + [5.0] * 300
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
    for share in (0.0, 0.05, 0.5, 0.95, 1.0):
        want = sorted(values)[max(1, -(-int(share * 1000) * len(values) // 1000)) - 1]
        assert topics._exact_quantile(df, "x", share) == want
    assert topics._exact_quantile(df.where("x < 0"), "x", 0.5) is None


def test_a_listed_word_has_one_group_on_both_ways(spark, monkeypatch):
    from corpusloom.functions import entities as ent

    rows = spark.createDataFrame([(1, "We saw Paris and Rome")], "row_id long, text string")
    listed = spark.createDataFrame([("Paris", "PER"), ("Paris", "LOC"), ("Rome", "LOC")], "word string, entity_group string")
    small = ent.extract_entities(rows, listed).first()["entities"]
    monkeypatch.setattr(ent, "small_rows", lambda _df: None)
    assert ent.extract_entities(rows, listed).first()["entities"] == small
    assert [e["entity_group"] for e in small if e["word"] == "Paris"] == ["LOC"]


def test_recipe_keys(spark):
    from corpusloom.plans import process

    df = spark.createDataFrame([(1, "a b c", 0, 0)], "row_id long, text string, is_bs int, topic int")
    for step, least in (("min_hhd_threshold", 1), ("min_hdd_threshold", 1)):
        kept, _ = process.process_train(df, {"filter_low_lexical_diversity": {"enabled": True, step: 0.0}})
        assert kept.count() <= least
    for steps in ({"filter_low_lexical_diversity": {"min_hd_threshold": 0.1}}, {"clean": True}):
        with pytest.raises(ValueError):
            process.process_train(df, steps)


@pytest.mark.parametrize(
    ("n", "bad", "topics"),
    [(200, 10, 1), (200, 2, 20), (36_000, 2, 1)],
    ids=["unequal classes", "small and missing topics", "more rows than a sample"],
)
def test_shared_texts_are_those_of_all_rows(spark, tmp_path, n, bad, topics):
    """Every row has a side: against a split worked out here, by the query and its twin."""
    docs = [
        (i, f"text {i * 7 % n // 3}", "en", None if topics > 1 and i % topics == 0 else f"src{i % topics}", 9)
        for i in range(n)
    ]
    labels = [(i, int(i // topics % bad > 0), 0) for i in range(n)]
    for name, rows, kind in (
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars int"),
        ("labels", labels, "doc_id long, quality int, toxic int"),
    ):
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / f"{name}.parquet"))
    sides = {"train": set(), "test": set()}
    for quality in (0, 1):
        ids = sorted(
            (i for i, q, _ in labels if q == quality),
            key=lambda i: hashlib.md5(f"{keys.SEED}:{i}".encode()).hexdigest(),
        )
        assert len(ids) % 10 == 0
        for place, i in enumerate(ids):
            sides["test" if place < len(ids) // 10 else "train"].add(docs[i][1])
    shared = len(sides["train"] & sides["test"])
    assert QUERIES["x03_shared_texts"](spark, str(tmp_path)).collect() == [(shared,)]
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert db.execute(ORACLES["x03_shared_texts"]).fetchall() == [(shared,)]


def test_an_unsampled_recipe_keeps_the_rest(spark):
    whole = process.unsampled(process.RECIPE_2)
    assert whole["processing"] == process.RECIPE_2["processing"]
    assert whole["splitting"]["stratified_sample"]["stratify_by"] == ["is_bs"]
    assert process.RECIPE_2["splitting"]["stratified_sample"]["enabled"]
    rows = spark.range(40).select(
        F.col("id").alias("row_id"), F.lit("a").alias("text"), (F.col("id") % 4 == 0).cast("int").alias("is_bs"),
        F.lit(None).cast("int").alias("topic"),
    )
    found = process.split_corpus(rows, whole).groupBy("is_bs", "split").count().collect()
    assert {tuple(r) for r in found} == {(0, "train", 27), (0, "test", 3), (1, "train", 9), (1, "test", 1)}


def test_baseline_separates(spark, tmp_path):
    data = [(i, ("storm rain wind " if i % 2 else "bread cake flour ") + f"w{i % 7}", i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "row_id long, text string, is_bs int")
    model = baseline.fit_baseline(df, max_terms=50, max_iter=50)
    scored = baseline.predict(model, df).collect()
    assert all(r["prediction"] == r["is_bs"] for r in scored)
    assert all(abs(sum(r["probability"]) - 1) < 1e-9 for r in scored)
    weights = {r["term"]: r["weight"] for r in baseline.term_weights(model, df).collect()}
    assert weights["storm"] > 0 > weights["bread"]
    # a saved model still takes the raw text
    from pyspark.ml import PipelineModel

    model.write().overwrite().save(str(tmp_path / "m"))
    again = baseline.predict(PipelineModel.load(str(tmp_path / "m")), df).collect()
    assert [r["prediction"] for r in again] == [r["prediction"] for r in scored]


def test_ml_features_equal_relational_tfidf(spark):
    df = spark.createDataFrame(
        [(1, "red fox red"), (2, "blue fox"), (3, "red sky at night")], "row_id long, text string"
    )
    want = {(r["row_id"], r["term"]): r["weight"] for r in baseline.tfidf_table(df).collect()}
    model = baseline.fit_features(df)
    words = model.stages[1].vocabulary
    for r in model.transform(df).collect():
        for i, w in zip(r["features"].indices, r["features"].values):
            assert want[(r["row_id"], words[i])] == pytest.approx(w)


def test_eda_report_names(t):
    assert {"nulls", "lengths", "richness", "topic_leakage"} <= set(eda.report(t.corpus))


def test_worker_code_travels_by_value():
    from pyspark import cloudpickle

    assert "corpusloom" in cloudpickle.list_registry_pickle_by_value()


def _exchanged_columns(df) -> set[str]:
    """Names of the columns that any shuffle of the plan moves."""
    import re

    plan = df._jdf.queryExecution().executedPlan()
    found, open_ = set(), [plan]
    while open_:
        node = open_.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            open_.append(node.inputPlan())
            continue
        if "Exchange" in node.nodeName() and "Broadcast" not in node.nodeName():
            found |= set(re.findall(r"(\w+)#\d+", node.output().mkString(",")))
        children = node.children()
        open_ += [children.apply(i) for i in range(children.size())]
    return found


def test_row_joins_leave_texts_where_they_are(spark, monkeypatch):
    """With broadcasts off, a corpus in buckets of its ids is not moved by joins on them."""
    from corpusloom import bounded
    from corpusloom.operators import windows
    from corpusloom.session import bucketed

    rows = [(i, f"text {i % 37}", i % 2) for i in range(200)] + [(900, None, 0), (901, None, 1)]
    corpus = bucketed(spark.createDataFrame(rows, "row_id long, text string, is_bs int"), "corpus", "row_id")
    monkeypatch.setattr(bounded.join_checked, "__defaults__", ("inner", 0))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = windows.keep_first(corpus)
        staged, _, alive = process.staged(corpus, {"remove_duplicates": True})
        topics = corpus.join(corpus.select("row_id", "is_bs").groupBy("row_id").count(), "row_id", "left")
        for found in (kept, staged, topics):
            assert "text" not in _exchanged_columns(found)
        assert sorted(r.row_id for r in kept.collect()) == [*range(37), 900]
        assert sorted(r.row_id for r in staged.where(alive).collect()) == [*range(37), 900]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_weights_within_the_row_equal_those_by_joins(spark, monkeypatch):
    from corpusloom.models import baseline

    texts = ["a cat sat on the mat", "the cat the cat", "", None, "dogs eat meat on mats", "zz", "über cat naïve"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    within = baseline.tfidf_table(df, max_terms=9)
    assert "Exchange" not in within._jdf.queryExecution().executedPlan().toString()
    got = {(r.row_id, r.term): (r.tf, round(r.weight, 9)) for r in within.collect()}
    monkeypatch.setattr(baseline, "small_rows", lambda table: None)
    joined = {(r.row_id, r.term): (r.tf, round(r.weight, 9)) for r in baseline.tfidf_table(df, max_terms=9).collect()}
    assert got == joined and len(got) > 8
