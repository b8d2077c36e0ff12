"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is contained in a document that holds at least ``THRESHOLD`` of the
item's different five-word shingles.  Signatures of whole documents say little
about an item of thirty shingles, so the search is turned round: items are
partitioned by size, and each partition has a sketch length, the number of
smallest shingle hashes (a bottom-k MinHash) of which a containing document
must hold at least one: an item may miss fewer shingles than its sketch has.
Documents that meet a sketch are candidates, and each candidate pair is
verified by the exact share of shingles, compared word by word.

All of it is DataFrame work: five shifted copies of the word array are
exploded side by side, so hashing and the look-up stay in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import bounded
from corpusloom.session import materialise

SHINGLE = 5
THRESHOLD = 0.8
NOT_A_WORD = r"[^\p{L}\p{N}]+"
WORDS = [f"w{i}" for i in range(SHINGLE)]


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), NOT_A_WORD), "")


def shingles(rows: DataFrame, key: str, text_col: str) -> DataFrame:
    """``(key, h, w0..w4)`` for every run of five words, repeats included.

    One to four words are one shingle, filled up with empty words; no word, none.
    """
    listed = rows.select(key, words(F.col(text_col)).alias("w")).where("size(w) > 0")
    padded = F.when(
        F.size("w") < SHINGLE, F.concat("w", F.array_repeat(F.lit(""), SHINGLE - F.size("w")))
    ).otherwise(F.col("w"))
    listed = listed.select(key, padded.alias("w"))
    shifted = [F.slice("w", i + 1, F.size("w")) for i in range(SHINGLE)]
    runs = listed.select(key, F.inline(F.arrays_zip(*shifted)).alias(*WORDS))
    return runs.where(f"{WORDS[-1]} IS NOT NULL").select(key, F.xxhash64(*WORDS).alias("h"), *WORDS)


def item_shingles(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Different shingles of each item, ``n_item`` of them, and which are in its sketch."""
    different = shingles(items.where("item_id IS NOT NULL"), "item_id", "text").distinct()
    of_item = Window.partitionBy("item_id")
    sized = different.withColumn("n_item", F.count("*").over(of_item))
    # partitions double in size; the largest size of a partition fixes its sketch
    largest = F.pow(F.lit(2), F.floor(F.log2("n_item")) + 1).cast("long") - 1
    may_miss = largest - F.ceil(largest * F.lit(threshold) - 1e-9)
    rank = F.row_number().over(of_item.orderBy("h", *WORDS))
    return sized.withColumn("in_sketch", rank <= may_miss + 1)


def contained(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(key, item_id, n_item, n_shared, containment)`` of every pair at ``threshold`` or more.

    Null, empty and blank texts are contained in nothing and contain nothing;
    rows without a key or item id are left out; rows that repeat a key count as
    one document; items with equal texts are reported each.
    """
    known = materialise(item_shingles(items, threshold), "item-shingles")
    docs = docs.where(F.col(key).isNotNull()).select(key, text_col)
    sketch = known.where("in_sketch").select("h").distinct()
    met = (
        shingles(docs, key, text_col)
        .join(bounded.checked(sketch), "h", "left_semi")
        .select(key, "h")
        .distinct()
    )
    pairs = met.join(known.where("in_sketch").select("h", "item_id"), "h").select(key, "item_id")
    pairs = materialise(pairs.distinct(), "contained-candidates")
    # texts of candidates only, looked at once more
    candidates = docs.join(bounded.checked(pairs.select(key).distinct()), key, "left_semi")
    all_shingles = known.select("h", *WORDS).distinct()
    held = (
        shingles(candidates, key, text_col)
        .join(bounded.checked(all_shingles), ["h", *WORDS], "left_semi")
        .distinct()
    )
    shared = (
        held.join(known, ["h", *WORDS])
        .join(pairs, [key, "item_id"])
        .groupBy(key, "item_id", "n_item")
        .agg(F.count("*").alias("n_shared"))
        .withColumn("containment", F.col("n_shared") / F.col("n_item"))
    )
    return shared.where(F.col("containment") >= threshold - 1e-9)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose text holds no test item.

    Rows are told apart by their text, so ids may be null or repeated; rows
    with a null text stay.
    """
    keyed = docs.withColumn("_text_key", F.sha2("text", 256))
    found = contained(keyed, items, "_text_key", "text", threshold).select("_text_key").distinct()
    held = materialise(found, "contained-texts")
    return keyed.join(bounded.checked(held), "_text_key", "left_anti").select(docs.columns)
