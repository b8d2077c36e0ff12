"""Labelled rows ready for training, with fixed-length token ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.bounded import small_rows
from corpusloom.session import materialise
from corpusloom.functions import text as tx
from corpusloom.operators import filters

PAD, UNKNOWN, FIRST_ID = 0, 1, 2
MAX_LENGTH = 64
VOCABULARY_SIZE = 30_000


def token_vocabulary(
    df: DataFrame, text_col: str = "text", size: int = VOCABULARY_SIZE
) -> DataFrame:
    """``(token, token_id)`` of the most frequent lower-cased tokens.

    The rank runs over at most ``size`` rows.
    """
    top = (
        df.select(F.explode(tx.tokens(F.lower(F.col(text_col)))).alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("c"))
        .orderBy(F.desc("c"), "token")
        .limit(size)
    )
    rank = F.row_number().over(Window.orderBy(F.desc("c"), "token"))
    return top.select("token", (rank + FIRST_ID - 1).cast("int").alias("token_id"))


def _ids_by_lookup(df: DataFrame, cut: Column, rows, out_col: str) -> DataFrame:
    """Ids from a broadcast dictionary, in Arrow batches: no shuffle."""
    known = df.sparkSession.sparkContext.broadcast({r["token"]: r["token_id"] for r in rows})

    @F.pandas_udf("array<int>")
    def look_up(tokens: pd.Series) -> pd.Series:
        ids = known.value
        return tokens.map(
            lambda row: None if row is None else [ids.get(t, UNKNOWN) for t in row]
        )

    return df.withColumn(out_col, look_up(cut))


def _ids_by_join(
    df: DataFrame, cut: Column, vocabulary: DataFrame, id_col: str, out_col: str
) -> DataFrame:
    ids = (
        df.select(id_col, F.posexplode(cut).alias("pos", "token"))
        .join(vocabulary, "token", "left")
        .groupBy(id_col)
        .agg(
            F.array_sort(
                F.collect_list(F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN)).alias("id")))
            ).alias(out_col)
        )
        .select(id_col, F.transform(out_col, lambda x: x["id"]).alias(out_col))
    )
    return df.join(ids, id_col, "left")


def encode(
    df: DataFrame,
    vocabulary: DataFrame,
    text_col: str = "text",
    id_col: str = "row_id",
    max_length: int = MAX_LENGTH,
) -> DataFrame:
    """``input_ids`` and ``attention_mask`` of exactly ``max_length``.

    Only the tokens that survive the cut are looked up: in a broadcast
    dictionary if the vocabulary is within the size bound, else by a join.
    """
    cut = F.slice(tx.tokens(F.lower(F.col(text_col))), 1, max_length)
    vocabulary = materialise(vocabulary, "vocabulary")
    rows = small_rows(vocabulary)
    if rows is None:
        out = _ids_by_join(df, cut, vocabulary, id_col, "_ids")
    else:
        out = _ids_by_lookup(df, cut, rows, "_ids")
    known = F.coalesce(F.col("_ids"), F.array().cast("array<int>"))
    missing = F.lit(max_length) - F.size(known)
    return (
        out.withColumn("input_ids", F.concat(known, F.array_repeat(F.lit(PAD), missing)))
        .withColumn(
            "attention_mask",
            F.concat(F.array_repeat(F.lit(1), F.size(known)), F.array_repeat(F.lit(0), missing)),
        )
        .drop("_ids")
    )


def prepare_rows(
    df: DataFrame,
    label_col: str = "is_bs",
    num_labels: int = 2,
    label_names: list[str] | None = None,
    use_entities: bool = False,
    entity_format: str = "append",
) -> DataFrame:
    """Label copy, entity merge, blank drop, label check."""
    out = filters.copy_column(df, label_col, "labels")
    if use_entities and "entities" in df.columns:
        out = out.withColumn(
            "text", tx.merge_entities(F.col("text"), F.col("entities"), entity_format)
        )
    return filters.enforce_labels(
        filters.drop_blank(out), "labels", num_labels, label_names, "label_name"
    )


def prepare_dataset(df: DataFrame, vocabulary: DataFrame | None = None, **options) -> DataFrame:
    """Prepared rows with token ids; evaluation sets pass the training vocabulary."""
    rows = prepare_rows(df, **options)
    if vocabulary is None:
        vocabulary = token_vocabulary(rows)
    return encode(rows, vocabulary)
