"""Entities of a row: finding, ordering and masking (survey M01, N01-N03, F07)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.bounded import small_rows
from corpusloom.functions.keys import text_seed
from corpusloom.functions.text import let
from corpusloom.schemas import ENTITY

# ---- fixed values -------------------------------------------------------
# A capitalised word that starts a letter run, with further such words behind.
CANDIDATE = r"(?:^|[^\p{L}])(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"
GROUPS = ("PER", "MISC", "LOC", "ORG")
DEFAULT_GROUP = "MISC"
MASK_IDS = 99_999
MASK_STRIDE = 7_919
# ---- end of fixed values ------------------------------------------------


def candidates(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(1))


def _group_of(word: Column, gazetteer: Mapping[str, str]) -> Column:
    by_group: dict[str, list[str]] = {}
    for name, group in sorted(gazetteer.items()):
        by_group.setdefault(group, []).append(name)
    chosen = F.lit(DEFAULT_GROUP)
    for group, names in by_group.items():
        chosen = F.when(word.isin(names), F.lit(group)).otherwise(chosen)
    return chosen


def tag_entities(text: Column, gazetteer: Mapping[str, str]) -> Column:
    """M01 as an expression: hits of the gazetteer get its group, others MISC."""
    return F.transform(
        candidates(F.coalesce(text, F.lit(""))),
        lambda w: F.struct(w.alias("word"), _group_of(w, gazetteer).alias("entity_group")),
    ).cast(f"array<{ENTITY.simpleString()}>")


def extract_entities(
    df: DataFrame,
    gazetteer: Mapping[str, str] | DataFrame,
    text_col: str = "text",
    id_col: str = "row_id",
    out_col: str = "entities",
) -> DataFrame:
    """Add the entity list of every row, in order of appearance.

    A gazetteer table ``(word, entity_group)`` within the size bound becomes
    part of the expression; a larger one is joined by word.
    """
    if isinstance(gazetteer, DataFrame):
        # a word listed in several groups has the first of them, however long the list is
        gazetteer = gazetteer.groupBy("word").agg(F.min("entity_group").alias("entity_group"))
        rows = small_rows(gazetteer)
        if rows is None:
            return _extract_by_join(df, gazetteer, text_col, id_col, out_col)
        gazetteer = {r["word"]: r["entity_group"] for r in rows}
    return df.withColumn(out_col, tag_entities(F.col(text_col), gazetteer))


def _extract_by_join(df, gazetteer, text_col, id_col, out_col):
    # frequent words are hot join keys: look every distinct word up once per
    # row group, and let AQE split what is still skewed
    found = df.select(
        id_col, F.posexplode(candidates(F.col(text_col))).alias("_pos", "word")
    )
    known = found.select("word").distinct().join(gazetteer, "word", "inner")
    tagged = (
        found.join(known.select("word", "entity_group"), "word", "left")
        .groupBy(id_col)
        .agg(
            F.transform(
                F.array_sort(
                    F.collect_list(
                        F.struct(
                            "_pos",
                            "word",
                            F.coalesce("entity_group", F.lit(DEFAULT_GROUP)).alias("g"),
                        )
                    )
                ),
                lambda x: F.struct(x["word"].alias("word"), x["g"].alias("entity_group")),
            ).alias(out_col)
        )
    )
    none = F.array().cast(f"array<{ENTITY.simpleString()}>")
    return df.join(tagged, id_col, "left").withColumn(
        out_col, F.coalesce(F.col(out_col), none)
    )


def explode_entities(df: DataFrame, entities_col: str = "entities") -> DataFrame:
    """One row per entity; a row without entities stays, with nulls."""
    return (
        df.withColumn("_e", F.explode_outer(entities_col))
        .withColumn("entity", F.col("_e.word"))
        .withColumn("entity_group", F.col("_e.entity_group"))
        .drop("_e", entities_col)
    )


def masking_order(entities: Column) -> Column:
    """Distinct words, longest first; equal lengths keep their order."""
    ranked = F.array_sort(
        F.transform(
            entities,
            lambda e, i: F.struct(
                (-F.char_length(e["word"])).alias("l"), i.alias("i"), e["word"].alias("w")
            ),
        )
    )
    return F.array_distinct(F.transform(ranked, lambda x: x["w"]))


def mask_entities(
    text: Column, entities: Column, entity_types: list[str] | None = None
) -> Column:
    """replace each distinct entity word by ``<MASK_id>``, one after another.

    Ids start at the seed of the text and advance by a stride that is coprime
    to the number of ids, so they are unique in a row.  ``entity_types`` is an
    opt-in filter; by default every group is masked.
    """
    listed = F.coalesce(entities, F.array().cast(f"array<{ENTITY.simpleString()}>"))
    if entity_types is not None:
        listed = F.filter(listed, lambda e: e["entity_group"].isin(list(entity_types)))

    def masked(seed: Column) -> Column:
        steps = F.transform(
            masking_order(listed),
            lambda w, rank: F.struct(
                w.alias("word"),
                F.concat(
                    F.lit("<MASK_"),
                    (F.pmod(seed + rank * MASK_STRIDE, F.lit(MASK_IDS)) + 1).cast("string"),
                    F.lit(">"),
                ).alias("mask"),
            ),
        )
        return F.aggregate(
            steps, text, lambda acc, s: F.replace(acc, s["word"], s["mask"])
        )

    return let(text_seed(text), masked)
