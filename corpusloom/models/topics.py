"""Topic assignment with an outlier topic, and topic terms (survey M05, M06)."""

from __future__ import annotations

import math

from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.bounded import join_checked
from corpusloom.functions.lexical import letter_runs
from corpusloom.functions.text import let
from corpusloom.models import vectors
from corpusloom.session import materialise

OUTLIER = -1


def _distance(point: Column, centre: Column) -> Column:
    return F.sqrt(
        F.aggregate(
            F.zip_with(point, centre, lambda a, b: (a - b) * (a - b)),
            F.lit(0.0),
            lambda acc, x: acc + x,
        )
    )


def relabel_by_size(df: DataFrame, cluster_col: str, min_size: int, out_col: str) -> DataFrame:
    """Clusters numbered from 0 by falling size; small or null ones become -1.

    The size table has one row per cluster.
    """
    sizes = (
        df.filter(F.col(cluster_col).isNotNull())
        .groupBy(cluster_col)
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") >= min_size)
        .withColumn(
            out_col,
            (F.row_number().over(Window.orderBy(F.desc("_n"), cluster_col)) - 1).cast("int"),
        )
        .select(cluster_col, out_col)
    )
    return join_checked(df, sizes, cluster_col, "left").withColumn(
        out_col, F.coalesce(F.col(out_col), F.lit(OUTLIER))
    )


def _exact_quantile(df: DataFrame, col: str, share: float):
    """The smallest value that ``share`` of the rows do not exceed.

    Values are ranged over partitions and counted there; only the partition that
    holds the answer is ordered, so no task sees all values and none is estimated.
    """
    counted = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    ranged = materialise(
        counted.repartitionByRange(col).withColumn("_part", F.spark_partition_id()), "quantile"
    )
    sizes = sorted(ranged.groupBy("_part").agg(F.sum("n").alias("n")).collect())
    total = sum(r["n"] for r in sizes)
    if not total:
        return None
    wanted, before = max(1, math.ceil(share * total)), 0
    for part, n in sizes:
        if before + n >= wanted:
            break
        before += n
    running = F.sum("n").over(Window.partitionBy("_part").orderBy(col))
    inside = ranged.where(F.col("_part") == part).withColumn("_seen", running)
    return inside.where(F.col("_seen") >= wanted - before).agg(F.min(col)).first()[0]


def assign_topics(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "row_id",
    n_topics: int = 20,
    n_components: int = 5,
    min_cluster_size: int = 60,
    distance_quantile: float = 0.95,
    width: int = 256,
    seed: int = vectors.SEED,
    out_col: str = "topic",
) -> DataFrame:
    """Hashed TF-IDF, principal components, k-means, then the outlier rule.

    Only (id, reduced vector) is kept between the steps.  Rows further from
    their centre than the given quantile of all distances, and clusters below
    the minimum size, form topic -1; the others are numbered by size.
    """
    vectored = vectors.document_vectors(df.select(id_col, text_col), text_col, "_v", width)
    reduced = vectors.reduce_dimensions(vectored, n_components, "_v", "_r").select(id_col, "_r")
    # k-means passes over its input many times
    reduced = materialise(reduced, "topic-vectors")
    # starting centres are drawn in row order: a fixed layout makes a fit repeatable
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = vectors.fit_kmeans(
        reduced.repartition(parts, id_col).sortWithinPartitions(id_col), n_topics, "_r", "_c", seed
    )
    clustered = model.transform(reduced)
    centres = F.array(
        *[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()]
    )
    placed = clustered.select(
        id_col,
        "_c",
        _distance(vector_to_array("_r"), F.element_at(centres, F.col("_c") + 1)).alias("_d"),
    )
    placed = materialise(placed, "topic-distances")
    bound = _exact_quantile(placed, "_d", distance_quantile)
    near = placed.withColumn("_c", F.when(F.col("_d") <= F.lit(bound), F.col("_c")))
    topics = relabel_by_size(near, "_c", min_cluster_size, out_col).select(id_col, out_col)
    return df.join(topics, id_col, "left")


def stop_words() -> list[str]:
    """The English stop words that come with Spark."""
    return StopWordsRemover.loadDefaultStopWords("english")


def topic_terms(
    df: DataFrame,
    text_col: str = "text",
    topic_col: str = "topic",
    k: int = 10,
    stop: list[str] | None = None,
) -> DataFrame:
    """Top 1-2-grams per topic by class-based TF-IDF.

    The weight is tf * ln(1 + A / f): tf the count in the topic, f the count
    over all topics, A the mean number of terms per topic.
    """
    stop = stop_words() if stop is None else stop

    def grams(kept: Column) -> Column:
        pairs = F.when(
            F.size(kept) > 1,
            F.zip_with(
                F.slice(kept, F.lit(1), F.size(kept) - 1),
                F.slice(kept, F.lit(2), F.size(kept) - 1),
                lambda a, b: F.concat_ws(" ", a, b),
            ),
        ).otherwise(F.array().cast("array<string>"))
        return F.concat(kept, pairs)

    kept = F.filter(letter_runs(F.col(text_col)), lambda w: ~w.isin(stop))
    counted = (
        df.filter(F.col(text_col).isNotNull() & F.col(topic_col).isNotNull())
        .select(topic_col, F.explode(let(kept, grams)).alias("term"))
        .groupBy(topic_col, "term")
        .agg(F.count("*").alias("tf"))
    )
    mean = counted.agg(F.sum("tf") / F.count_distinct(topic_col)).scalar()
    rank = Window.partitionBy(topic_col).orderBy(F.desc("weight"), "term")
    return (
        # a term's group holds one row per topic
        counted.withColumn("f", F.sum("tf").over(Window.partitionBy("term")))
        .withColumn("weight", F.round(F.col("tf") * F.ln(F.lit(1.0) + mean / F.col("f")), 6))
        .withColumn("rank", F.row_number().over(rank))
        .filter(F.col("rank") <= k)
        .select(topic_col, "rank", "term", "tf", "weight")
    )
