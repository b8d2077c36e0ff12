"""The tables of an exploratory report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import lexical, text as tx
from corpusloom.operators import aggregates, evaluation, filters, joins
from corpusloom.session import materialise

LENGTHS = [f"{m}_length" for m in tx.LENGTH_METHODS]
RICHNESS = ["ttr", "mtld", "hdd"]


def measures(
    df: DataFrame,
    lengths: bool = True,
    richness: tuple[str, ...] = ("ttr", "mtld", "hdd"),
    label_col: str = "is_bs",
) -> DataFrame:
    """Per row: lengths and lexical richness, without the text, written once."""
    out = df
    if lengths:
        for method in tx.LENGTH_METHODS:
            out, _ = tx.add_length_column(out, "text", method)
    if richness:
        out = lexical.add_richness(out, "text", richness)
    names = (LENGTHS if lengths else []) + list(richness)
    return materialise(out.select("row_id", label_col, *names), "measures")


def topic_leakage(df: DataFrame, topic_col: str = "topic", label_col: str = "is_bs") -> DataFrame:
    """How well a topic's majority label predicts the label."""
    majority = aggregates.majority_label(df, topic_col, label_col, "topic_pred")
    predicted = joins.lookup(df.select(topic_col, label_col), majority, topic_col)
    return evaluation.confusion_matrix(predicted, label_col, "topic_pred")


def report(df: DataFrame, label_col: str = "is_bs") -> dict[str, DataFrame]:
    """All tables; each is an ordinary frame."""
    measured = measures(df, label_col=label_col)
    topics = aggregates.topic_label_summary(df, "topic", label_col)
    balanced = filters.balanced_topics(topics)
    return {
        "nulls": filters.null_profile(df),
        "duplicates": aggregates.duplicate_count(df),
        "classes": aggregates.value_counts(df, label_col),
        "lengths": aggregates.describe(measured, LENGTHS, label_col),
        "richness": aggregates.describe(measured, RICHNESS, label_col),
        **{
            f"box_{m}": aggregates.box_stats(measured, m, label_col)
            for m in [*LENGTHS, *RICHNESS]
        },
        "topics": topics,
        "topic_bands": aggregates.band_tally(topics),
        "topic_ratio_histogram": aggregates.histogram(topics, "fake_ratio"),
        "balanced_rows": joins.keep_keys(df, balanced.select("topic"), "topic").agg(
            F.count("*").alias("n_rows")
        ),
        "topic_leakage": topic_leakage(df, "topic", label_col),
    }
