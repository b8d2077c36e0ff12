"""Ranking operators (survey W01-W06, W08)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.bounded import join_checked
from corpusloom.functions import keys
from corpusloom.operators.joins import align_counts
from corpusloom.session import materialise

FIRST_N_SALTS = 64


def repeated(df: DataFrame, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """The ids of rows whose text a row of a smaller id has; nulls are one text.

    Hashes and ids are written once; only texts that occur several times go further.
    """
    hashed = materialise(
        df.select(id_col, keys.text_identity(F.col(text_col)).alias("_k")), "text-hashes"
    )
    several = hashed.groupBy("_k").agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    rest = hashed.join(several, hashed["_k"].eqNullSafe(several["_k"]))
    return rest.where(F.col(id_col) != F.col("_first")).select(id_col)


def keep_first(df: DataFrame, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """The row with the smallest id of each exact text; nulls are one text.

    Only (hash, id) pairs are grouped, with a map-side minimum, so a text that
    fills a third of the corpus costs no more than any other.  The wide rows meet the
    ids that go, not those that stay: a broadcast while these are few, else a join
    that leaves a table in buckets of the id (see ``session.bucketed``) where it is.
    """
    return join_checked(df, repeated(df, text_col, id_col), id_col, "left_anti")


def first_n(df: DataFrame, origin: str | list[str], n: int, order_col: str = "row_id") -> DataFrame:
    """The first ``n`` rows of every origin.

    Rows with one order value follow the hash of all their columns; only wholly
    equal rows stand or fall together.
    Works out each origin's n-th smallest order value from two narrow columns,
    in salted and then in merged groups, and filters the wide rows by it: no
    text is shuffled and no origin is ranked as one group.
    """
    origin = [origin] if isinstance(origin, str) else list(origin)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    place = F.struct(F.col(order_col).alias("by"), whole.alias("tie"))
    narrow = df.select(*origin, place.alias("_place")).withColumn(
        "_salt", F.pmod(F.col("_place.tie"), F.lit(FIRST_N_SALTS))
    )
    salted = Window.partitionBy(*origin, "_salt").orderBy("_place")
    merged = Window.partitionBy(*origin).orderBy("_place")
    cut = (
        narrow.withColumn("_r", F.row_number().over(salted))
        .filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(merged))
        .filter(F.col("_r") <= n)
        .groupBy(*origin)
        .agg(F.max("_place").alias("_cut"))
    )
    before = F.col(order_col) < F.col("_cut.by")
    same = F.col(order_col).eqNullSafe(F.col("_cut.by"))
    # the hash is looked at for rows at the cut only
    kept = F.when(same, whole <= F.col("_cut.tie")).otherwise(
        F.coalesce(before, F.col(order_col).isNull())
    )
    return join_checked(df, cut, origin).filter(kept).drop("_cut")


def top_k_per_class(
    df: DataFrame,
    category: str,
    k: int = 10,
    value_col: str = "entity",
    category_col: str = "entity_group",
    label_col: str = "is_bs",
) -> DataFrame:
    """The k most frequent values of a category in each class, side by side."""
    counted = (
        df.filter((F.col(category_col) == category) & F.col(label_col).isin(0, 1))
        .groupBy(label_col, value_col)
        .agg(F.count("*").alias("c"))
    )
    rank = Window.partitionBy(label_col).orderBy(F.desc("c"), value_col)
    top = counted.withColumn("_r", F.row_number().over(rank)).filter(F.col("_r") <= k)

    def side(label: int, name: str) -> DataFrame:
        return top.filter(F.col(label_col) == label).select(value_col, F.col("c").alias(name))

    return align_counts(
        side(1, "n_label_1"), side(0, "n_label_0"), value_col, ["n_label_1", "n_label_0"]
    ).orderBy(F.desc("n_label_1"), value_col)


def extremes(df: DataFrame, weight_col: str = "weight", key_col: str = "term", k: int = 30):
    """The k largest and the k smallest weights."""
    top = df.orderBy(F.desc(weight_col), key_col).limit(k)
    bottom = df.orderBy(F.asc(weight_col), key_col).limit(k)
    return top, bottom


def head_by(df: DataFrame, column: str, key_col: str, n: int = 10) -> DataFrame:
    """The n rows with the highest value."""
    return df.orderBy(F.desc(column), key_col).limit(n)


def shuffled(
    df: DataFrame, id_col: str = "row_id", seed: int = keys.SEED, out_col: str = "shuffle_pos"
) -> DataFrame:
    """The position (from 0) of each row in a seeded random order.

    The order key is uniform, so its leading digits cut the rows into equal
    buckets: a running total over the fixed number of buckets gives every
    bucket its first position, and ranks are only taken within buckets.
    """
    keyed = df.withColumn("_key", keys.order_key(F.col(id_col), seed)).withColumn(
        "_bucket", keys.key_bucket(F.col("_key"))
    )
    sizes = (
        df.select(keys.key_bucket(keys.order_key(F.col(id_col), seed)).alias("_bucket"))
        .groupBy("_bucket")
        .agg(F.count("*").alias("_n"))
    )
    # at most 16**BUCKET_DIGITS rows
    starts = sizes.withColumn(
        "_start", F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")
    ).select("_bucket", "_start")
    within = Window.partitionBy("_bucket").orderBy("_key", id_col)
    return (
        keyed.join(F.broadcast(starts), "_bucket")
        .withColumn(out_col, F.col("_start") + F.row_number().over(within) - 1)
        .drop("_key", "_bucket", "_start")
    )


def preview(df: DataFrame, n: int = 5, id_col: str = "row_id") -> DataFrame:
    """The first n rows by id."""
    return df.orderBy(id_col).limit(n)
