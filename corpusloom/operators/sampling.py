"""Sampling and splitting (survey G01-G04).

Everything is exact and deterministic: rows are taken in the order of an md5
key.  The key is uniform, so "the n smallest keys of a stratum" is found from a
histogram over key prefixes, and only the rows of one boundary bucket per
stratum are ever ranked.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.bounded import checked, join_checked, small_rows
from corpusloom.session import materialise
from corpusloom.functions import keys
from corpusloom.operators.joins import keep_keys
from corpusloom.schemas import require

STRATUM = "_stratum"


def large_topics(
    df: DataFrame, min_topic_size: int = 100, topic_col: str = "topic"
) -> DataFrame:
    """Topics with enough rows; the outlier topic is no exception."""
    return (
        df.filter(F.col(topic_col).isNotNull())
        .groupBy(topic_col)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= min_topic_size)
        .select(topic_col)
    )


def topic_parity(df: DataFrame, min_topic_size: int = 100, topic_col: str = "topic") -> DataFrame:
    """Rows of topics with enough rows."""
    return keep_keys(df, large_topics(df, min_topic_size, topic_col), topic_col)


class Cut:
    """For every stratum the last key that is still taken.

    ``table`` has at most one row per stratum; a stratum without a row is taken
    whole.  It can be applied to any frame with the stratum columns and ids.
    """

    def __init__(self, table: DataFrame, stratum: Column, id_col: str, seed: int):
        self.table, self.stratum, self.id_col, self.seed = table, stratum, id_col, seed

    def flag(self, df: DataFrame) -> DataFrame:
        """Add ``_taken`` by comparison with the cut: wide rows are not shuffled."""
        key = F.col("_key")
        taken = (
            F.col("_edge").isNull()
            | (keys.key_bucket(key) < F.col("_edge"))
            | (key < F.col("_last_key"))
            | ((key == F.col("_last_key")) & (F.col(self.id_col) <= F.col("_last_id")))
        )
        return (
            df.withColumns(
                {STRATUM: self.stratum, "_key": keys.order_key(F.col(self.id_col), self.seed)}
            )
            .join(self.table, STRATUM, "left")
            .withColumn("_taken", F.coalesce(taken, F.lit(False)))
            .drop(STRATUM, "_key", "_edge", "_last_key", "_last_id")
        )

    def keep(self, df: DataFrame) -> DataFrame:
        return self.flag(df).filter("_taken").drop("_taken")


def find_cut(
    df: DataFrame, quotas: DataFrame, stratum: Column, id_col: str, seed: int
) -> Cut:
    """The cut that takes the ``_quota`` rows with the smallest keys per stratum.

    Two passes over (stratum, id) alone.
    """
    narrow = df.select(
        id_col, stratum.alias(STRATUM), keys.order_key(F.col(id_col), seed).alias("_key")
    ).withColumn("_bucket", keys.key_bucket(F.col("_key")))
    histogram = narrow.groupBy(STRATUM, "_bucket").agg(F.count("*").alias("_n"))
    running = Window.partitionBy(STRATUM).orderBy("_bucket")
    # per stratum: the first bucket that is not taken whole, and what it still gives
    edge = (
        join_checked(histogram, quotas, STRATUM)
        .withColumn("_before", F.sum("_n").over(running) - F.col("_n"))
        .filter(F.col("_before") + F.col("_n") > F.col("_quota"))
        .groupBy(STRATUM)
        .agg(
            F.min("_bucket").alias("_edge"),
            F.min_by(F.col("_quota") - F.col("_before"), "_bucket").alias("_rest"),
        )
    )
    edge = materialise(edge, "cut-edge")
    rows = small_rows(edge)
    small = rows is not None
    if small:
        edge = F.broadcast(df.sparkSession.createDataFrame(rows, edge.schema))
    last = (
        narrow.join(edge, STRATUM)
        .filter(F.col("_bucket") == F.col("_edge"))
        .withColumn(
            "_rank", F.row_number().over(Window.partitionBy(STRATUM).orderBy("_key", id_col))
        )
        .filter(F.col("_rank") == F.col("_rest"))
        .select(STRATUM, F.col("_key").alias("_last_key"), F.col(id_col).alias("_last_id"))
    )
    cut = edge.join(checked(last), STRATUM, "left").select(
        STRATUM, "_edge", "_last_key", "_last_id"
    )
    if small:  # as many rows as strata with an edge
        cut = F.broadcast(cut)
    return Cut(cut, stratum, id_col, seed)


def stratum_counts(df: DataFrame, stratum: Column) -> DataFrame:
    return df.groupBy(stratum.alias(STRATUM)).agg(F.count("*").alias("_n"))


def balanced_cut(
    df: DataFrame,
    stratify_by: list[str],
    sample_n: int | None,
    id_col: str = "row_id",
    seed: int = keys.SEED,
) -> Cut:
    """The cut of a sample with the same number of rows from every stratum.

    The number is ``sample_n`` shared out evenly, or the smallest stratum.
    """
    if not stratify_by or sample_n is None:
        raise ValueError("a stratified sample needs 'stratify_by' and 'sample_n'")
    require(df, id_col, *stratify_by)
    stratum = keys.composite_key(*stratify_by)
    counts = stratum_counts(df, stratum)
    everything = Window.partitionBy()  # one row per stratum
    quotas = counts.select(
        STRATUM,
        F.least(
            F.floor(F.lit(int(sample_n)) / F.count("*").over(everything)),
            F.min("_n").over(everything),
        ).alias("_quota"),
    )
    return find_cut(df, quotas, stratum, id_col, seed)


def balanced_sample(
    df: DataFrame,
    stratify_by: list[str],
    sample_n: int | None,
    id_col: str = "row_id",
    seed: int = keys.SEED,
) -> DataFrame:
    """The same number of rows from every stratum, without replacement."""
    return balanced_cut(df, stratify_by, sample_n, id_col, seed).keep(df)


def check_ratios(train_ratio: float, test_ratio: float) -> None:
    if abs(train_ratio + test_ratio - 1.0) >= 1e-6:
        raise ValueError("train and test ratios must sum to 1")


def split_quotas(counts: DataFrame, test_ratio: float, strict: bool = True) -> DataFrame:
    """Test rows per stratum: the rounded-up total, shared by largest remainder.

    The table has one row per stratum.
    """
    share = F.lit(Decimal(str(test_ratio))).cast("decimal(18,12)")
    everything = Window.partitionBy()
    size = F.when(F.col("_n") >= (2 if strict else 1), F.col("_n")).otherwise(
        F.raise_error(F.concat(F.lit("stratum with fewer than 2 rows: "), F.col(STRATUM)))
    )
    exact = share * F.col("_n").cast("decimal(19,0)")
    return (
        counts.withColumn("_n", size)
        .withColumn("_total", F.ceil(share * F.sum("_n").over(everything)).cast("long"))
        .withColumn("_floor", F.floor(exact).cast("long"))
        .withColumn("_part", exact - F.col("_floor"))
        .withColumn("_spare", F.col("_total") - F.sum("_floor").over(everything))
        .withColumn("_place", F.row_number().over(Window.orderBy(F.desc("_part"), STRATUM)))
        .withColumn(
            "_quota",
            F.col("_floor") + F.when(F.col("_place") <= F.col("_spare"), 1).otherwise(0),
        )
        .select(STRATUM, "_quota")
    )


def split_cut(
    df: DataFrame,
    test_ratio: float = 0.1,
    stratify_by: list[str] | None = None,
    id_col: str = "row_id",
    seed: int = keys.SEED,
) -> Cut:
    """The cut between test rows (taken) and train rows."""
    if stratify_by:
        require(df, *stratify_by)
    stratum = keys.composite_key(*stratify_by) if stratify_by else F.lit("all")
    quotas = split_quotas(stratum_counts(df, stratum), test_ratio, strict=bool(stratify_by))
    return find_cut(df, quotas, stratum, id_col, seed)


def name_sides(flagged: DataFrame, out_col: str = "split") -> DataFrame:
    return flagged.withColumn(out_col, F.when(F.col("_taken"), "test").otherwise("train")).drop(
        "_taken"
    )


def stratified_split(
    df: DataFrame,
    train_ratio: float = 0.9,
    test_ratio: float = 0.1,
    stratify_by: list[str] | None = None,
    id_col: str = "row_id",
    seed: int = keys.SEED,
    out_col: str = "split",
) -> DataFrame:
    """Add ``split``; strata keep their proportions, every row is in one side."""
    check_ratios(train_ratio, test_ratio)
    return name_sides(split_cut(df, test_ratio, stratify_by, id_col, seed).flag(df), out_col)


def train_only(
    split: DataFrame, transform: Callable[[DataFrame], DataFrame], split_col: str = "split"
) -> tuple[DataFrame, DataFrame]:
    """Transformed train rows and untouched test rows of a written split."""
    train = split.filter(F.col(split_col) == "train").drop(split_col)
    test = split.filter(F.col(split_col) == "test").drop(split_col)
    return transform(train), test
