"""Synthetic labelled posts (survey S08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import keys

# A post is one line whose parts are drawn from these slots; numbers are drawn as well.
# Promises: what is said of the topic, who says so, what it is said to bring.
PROMISES = {
    "praise": ["the best kept trick", "a small miracle", "pure gold", "the end of all worry"],
    "witness": ["my neighbour", "a retired engineer", "half of our street", "the man at the market"],
    "gain": ["saves you a fortune", "doubles everything", "never fails"],
}
# Reports: where it was looked at, what came out, what stays open.
REPORTS = {
    "site": ["the north depot", "two villages", "a rented hall", "our own stock", "the old mill"],
    "result": ["costs fell a little", "no change was seen", "losses rose in winter"],
    "gap": ["Summer is not covered.", "One meter was broken.", "Nobody has repeated it yet."],
}
DEFAULT_TOPICS = ["garden planning", "home insurance", "rail timetables", "cold storage"]


def _pick(options: list[str], seed: int, role: str, row: Column) -> Column:
    """An option chosen by the md5 of seed, role and row."""
    number = F.conv(
        F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:{role}"), row.cast("string"))), 1, 8),
        16,
        10,
    ).cast("long")
    listed = F.array(*[F.lit(o) for o in options])
    return F.element_at(listed, (number % len(options) + 1).cast("int"))


def _number(seed: int, row: Column, low: int, span: int) -> Column:
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:number"), row.cast("string"))), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % span + low).cast("string")


def post_text(slots: dict[str, list[str]], topic: Column, row: Column, seed: int) -> Column:
    """One line about the topic, with one choice for each slot and one number."""
    part = {name: _pick(options, seed, name, row) for name, options in slots.items()}
    if "praise" in part:
        return F.concat(
            part["witness"], F.lit(" calls "), topic, F.lit(" "), part["praise"], F.lit(": it "),
            part["gain"], F.lit(" within "), _number(seed, row, 2, 9), F.lit(" days!"),
        )
    return F.concat(
        F.lit("On "), topic, F.lit(", from "), part["site"], F.lit(" ("), _number(seed, row, 10, 90),
        F.lit(" samples): "), part["result"], F.lit(". "), part["gap"],
    )


def posts_about(topics: DataFrame, seed: int = keys.SEED) -> DataFrame:
    """For every ``(row_id, topic)`` row one post of each class: label 1 and 0."""
    both = F.array(
        *[
            F.struct(
                (F.col("row_id") * 2 + (1 - label)).alias("row_id"),
                post_text(slots, F.col("topic"), F.col("row_id") * 2 + (1 - label), seed).alias(
                    "text"
                ),
                F.lit(label).alias("is_bs"),
            )
            for label, slots in ((1, PROMISES), (0, REPORTS))
        ]
    )
    return topics.select(F.inline(both))


def synthetic_posts(
    spark: SparkSession,
    n_per_class: int = 25,
    topics: list[str] | None = None,
    seed: int = keys.SEED,
) -> DataFrame:
    """``n_per_class`` posts of each class on topics drawn from a list."""
    chosen = spark.range(n_per_class).select(
        F.col("id").alias("row_id"),
        _pick(list(topics or DEFAULT_TOPICS), seed, "topic", F.col("id")).alias("topic"),
    )
    return posts_about(chosen, seed)
