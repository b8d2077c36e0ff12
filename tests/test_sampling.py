import hashlib
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.operators import sampling
from corpusloom.plans import process

QUIET = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def key(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


def frame(spark, sizes):
    data, at = [], 0
    for label, n in enumerate(sizes):
        data += [(at + j, label) for j in range(n)]
        at += n
    return spark.createDataFrame(data, "row_id long, is_bs int"), data


@QUIET
@given(st.lists(st.integers(1, 60), min_size=1, max_size=4), st.integers(1, 150))
def test_balanced_sample(spark, sizes, n):
    df, data = frame(spark, sizes)
    quota = min(n // len(sizes), min(sizes))
    want = []
    for label in range(len(sizes)):
        want += sorted((i for i, x in data if x == label), key=key)[:quota]
    got = sampling.balanced_sample(df, ["is_bs"], n)
    assert sorted(r["row_id"] for r in got.collect()) == sorted(want)


@QUIET
@given(st.lists(st.integers(2, 60), min_size=1, max_size=4), st.sampled_from([0.1, 0.2, 0.25, 0.5]))
def test_split(spark, sizes, ratio):
    df, _ = frame(spark, sizes)
    got = sampling.stratified_split(df, 1 - ratio, ratio, ["is_bs"]).collect()
    assert sorted(r["row_id"] for r in got) == list(range(sum(sizes)))
    held = [r for r in got if r["split"] == "test"]
    assert len(held) == math.ceil(round(ratio * sum(sizes), 9))
    for label, n in enumerate(sizes):
        assert abs(sum(r["is_bs"] == label for r in held) - ratio * n) < 1
    again = sampling.stratified_split(df.repartition(3), 1 - ratio, ratio, ["is_bs"])
    assert sorted(again.collect()) == sorted(got)


def test_hot_stratum_is_exact(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("row_id"), (F.col("id") % 20 == 0).cast("int").alias("is_bs")
    )
    got = {r["row_id"] for r in sampling.balanced_sample(df, ["is_bs"], 1500).collect()}
    want = set(sorted((i for i in range(20_000) if i % 20), key=key)[:750])
    want |= set(sorted(range(0, 20_000, 20), key=key)[:750])
    assert got == want


def test_errors(spark):
    df, _ = frame(spark, [3, 1])
    with pytest.raises(ValueError):
        sampling.balanced_sample(df, [], 10)
    with pytest.raises(ValueError):
        sampling.balanced_sample(df, ["is_bs"], None)
    with pytest.raises(ValueError):
        sampling.balanced_sample(df, ["nope"], 10)
    with pytest.raises(ValueError):
        sampling.stratified_split(df, 0.9, 0.2)
    with pytest.raises(Exception, match="fewer than 2"):
        sampling.stratified_split(df, 0.9, 0.1, ["is_bs"]).collect()


def test_null_in_key(spark):
    df = spark.createDataFrame(
        [(i, None if i < 4 else 1) for i in range(10)], "row_id long, is_bs int"
    )
    got = sampling.balanced_sample(df, ["is_bs"], 6).collect()
    assert sum(r["is_bs"] is None for r in got) == 3 and len(got) == 6


def test_topic_parity_keeps_outlier_rule(spark):
    df = spark.createDataFrame([(i, -1 if i < 5 else 2) for i in range(7)], "row_id long, topic int")
    assert {r["topic"] for r in sampling.topic_parity(df, 3).collect()} == {-1}


def test_recipe_steps(spark):
    text = "Ann walks to the market and buys {} apples with Bob"
    data = [
        (1, text.format("red"), [("Ann", "PER")]),
        (2, text.format("red"), [("Ann", "PER")]),
        (3, "too short", []),
        (4, "same same same same same same same same same same", []),
        (5, text.format("“green”"), [("Bob", "PER")]),
    ]
    df = spark.createDataFrame(
        data, "row_id long, text string, entities array<struct<word:string,entity_group:string>>"
    )
    steps = {
        "remove_duplicates": True,
        "normalize_text_length": {"enabled": True, "min_tokens": 5, "max_tokens": 20},
        "clean_text": True,
        "mask_entities": {"enabled": True},
        "filter_low_lexical_diversity": {"enabled": True, "min_hhd_threshold": 0.7},
    }
    train, audit = process.process_train(df, steps)
    kept = {r["row_id"]: r["text"] for r in train.collect()}
    assert set(kept) == {1, 5}
    assert kept[1].startswith("<MASK_") and '"green"' in kept[5] and "Bob" not in kept[5]
    assert [tuple(r) for r in audit.collect()] == [
        ("remove_duplicates", 5, 4, 0),
        ("normalize_text_length", 4, 3, 0),
        ("clean_text", 3, 3, 1),
        ("mask_entities", 3, 3, 2),
        ("filter_low_lexical_diversity", 3, 2, 0),
    ]
    same, _ = process.process_train(df, {})
    assert same.count() == 5
    with pytest.raises(ValueError):
        process.process_train(df, {"normalize_text_length": {"enabled": True}})
