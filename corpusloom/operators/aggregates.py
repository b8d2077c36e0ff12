"""Aggregations (survey A01-A06, A10-A16)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.bounded import join_checked
from corpusloom.functions import keys, urls
from corpusloom.operators import quantiles as exact
from corpusloom.operators.joins import mentions_own_alias, own_alias_hits

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def topic_label_summary(
    df: DataFrame, topic_col: str = "topic", label_col: str = "is_bs"
) -> DataFrame:
    """Rows per topic and label, total and share of label 1."""
    label = F.col(label_col)
    return (
        df.filter(F.col(topic_col).isNotNull() & label.isNotNull())
        .groupBy(topic_col)
        .agg(
            F.count_if(label == 0).alias("n_label_0"),
            F.count_if(label == 1).alias("n_label_1"),
            F.count("*").alias("total"),
        )
        .withColumn("fake_ratio", F.col("n_label_1") / F.col("total"))
    )


def value_counts(df: DataFrame, *columns: str, name: str = "n_rows") -> DataFrame:
    """Rows per key, most frequent first; null keys are left out."""
    return (
        df.dropna(subset=list(columns))
        .groupBy(*columns)
        .agg(F.count("*").alias(name))
        .orderBy(F.desc(name), *columns)
    )


def exact_quantiles(
    df: DataFrame, group_col: str, metrics: list[str], quantiles: Mapping[str, float]
) -> DataFrame:
    """Exact quantiles (linear) per group and metric; see ``quantiles``."""
    found = exact.of_tally(exact.tally(df, group_col, metrics), quantiles)
    return found.select(F.col(exact.GROUP).alias(group_col), F.col(exact.METRIC).alias("metric"), *quantiles)


def describe(
    df: DataFrame,
    metrics: list[str],
    group_col: str = "is_bs",
    quantiles: Mapping[str, float] = QUARTILES,
    approximate: bool = False,
) -> DataFrame:
    """Count, mean, std, min, quantiles and max per group and metric.

    Whole-number metrics (text lengths) have few distinct values, so Spark's
    ``percentile`` stays small.  Fractions are counted once by value, and all
    is worked out from the counts; ``approximate`` trades exactness for one pass.
    """
    whole = all(
        isinstance(df.schema[m].dataType, (T.IntegerType, T.LongType, T.ShortType))
        for m in metrics
    )
    on, names = [exact.GROUP, exact.METRIC], list(quantiles)
    if not (whole or approximate):
        tallied = exact.tally(df, group_col, metrics)
        found = exact.of_tally(tallied, quantiles)
        means = tallied.groupBy(*on).agg((F.sum(F.col("value") * F.col("c")) / F.sum("c")).alias("mean"))
        away = F.col("value") - F.col("mean")
        spread = join_checked(tallied, means, on).groupBy(*on, "mean").agg(
            F.sum(away * away * F.col("c")).alias("_square")
        )
        # one row has no deviation
        std = F.when(F.col("n") > 1, F.sqrt(F.col("_square") / (F.col("n") - 1)))
        out = found.join(spread, on).withColumn("std", std)
    else:
        points = F.array(*[F.lit(float(q)) for q in quantiles.values()])
        of = F.percentile_approx("value", points, 100_000) if approximate else F.percentile("value", points)
        out = (
            exact.long_rows(df, group_col, metrics)
            .groupBy(*on)
            .agg(
                F.count("value").alias("n"),
                F.avg("value").alias("mean"),
                F.stddev_samp("value").alias("std"),
                F.min("value").alias("min"),
                F.max("value").alias("max"),
                of.alias("_q"),
            )
        )
        for i, name in enumerate(names):
            out = out.withColumn(name, F.col("_q")[i])
    return out.select(
        F.col(exact.GROUP).alias(group_col), F.col(exact.METRIC).alias("metric"),
        "n", "mean", "std", "min", *names, "max",
    )


def duplicate_count(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows beyond the first of each text; nulls count as one text."""
    per_text = df.groupBy(keys.text_identity(F.col(text_col)).alias("k")).agg(
        F.count("*").alias("c")
    )
    return per_text.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"))


def band_tally(topics: DataFrame, low: float = 0.4, high: float = 0.6) -> DataFrame:
    """How many topics fall into each label-share band."""
    r = F.col("fake_ratio")
    return topics.agg(
        F.count("*").alias("n_topics"),
        F.count_if(r == 1).alias("only_1"),
        F.count_if(r > 0.5).alias("above_half"),
        F.count_if(r < 0.5).alias("below_half"),
        F.count_if(r == 0).alias("only_0"),
        F.count_if((r > low) & (r < high)).alias("in_band"),
    )


def majority_label(
    df: DataFrame, key_col: str = "topic", label_col: str = "is_bs", out_col: str = "topic_pred"
) -> DataFrame:
    """1 where more than half of the key's rows have label 1; a tie is 0."""
    return (
        df.filter(F.col(key_col).isNotNull())
        .groupBy(key_col)
        .agg((F.avg(label_col) > 0.5).cast("int").alias(out_col))
    )


def cluster_label_counts(
    df: DataFrame, cluster_col: str = "cluster", label_col: str = "is_bs"
) -> DataFrame:
    """A10: rows per cluster and label."""
    return df.groupBy(cluster_col, label_col).agg(F.count("*").alias("n_rows"))


def alias_leakage(
    df: DataFrame,
    aliases: Mapping[object, Iterable[str]],
    text_col: str = "text",
    label_col: str = "is_bs",
) -> DataFrame:
    """Rows per label that mention an alias of that label; no hits, no row."""
    return (
        df.filter(mentions_own_alias(F.col(text_col), F.col(label_col), aliases))
        .groupBy(F.col(label_col).alias("label"))
        .agg(F.count("*").alias("n_hits"))
    )


def alias_table_leakage(
    df: DataFrame,
    aliases: DataFrame,
    text_col: str = "text",
    label_col: str = "is_bs",
    row_col: str = "row_id",
) -> DataFrame:
    """A11 with a table ``label, alias`` of any length; no hits, no row."""
    hits = own_alias_hits(df, aliases, text_col, label_col, row_col)
    return hits.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n_hits"))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """Distinct keys."""
    return df.select(*columns).distinct()


def rows_per_host(df: DataFrame, hosts: Iterable[str], url_col: str = "url") -> DataFrame:
    """Rows of each listed host, 0 for none, from one pass."""
    listed = urls.normalise_hosts(hosts)
    counted = (
        df.select(urls.url_host(F.col(url_col)).alias("host"))
        .filter(F.col("host").isin(listed))
        .groupBy("host")
        .agg(F.count("*").alias("n_rows"))
    )
    table = df.sparkSession.createDataFrame([(h,) for h in listed], "host string")
    return table.join(counted, "host", "left").select(
        "host", F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width bins over the value range; the top edge is in the last bin.

    If all values are equal the range is widened by one half on both sides.
    """
    x = F.col(column)
    flat = F.when(F.min(x) == F.max(x), 0.5).otherwise(0.0)
    span = df.agg(F.struct((F.min(x) - flat).alias("lo"), (F.max(x) + flat).alias("hi"))).scalar()
    width = (F.col("hi") - F.col("lo")) / bins
    bin_of = F.least(F.width_bucket(x, F.col("lo"), F.col("hi"), F.lit(bins)), F.lit(bins))
    return (
        df.filter(x.isNotNull())
        .select(column, span.alias("_span"))
        .select(x, F.col("_span.lo").alias("lo"), F.col("_span.hi").alias("hi"))
        .withColumn("bin", bin_of.cast("int"))
        .groupBy("bin", "lo", "hi")
        .agg(F.count("*").alias("n_rows"))
        .select(
            "bin",
            (F.col("lo") + (F.col("bin") - 1) * width).alias("bin_from"),
            (F.col("lo") + F.col("bin") * width).alias("bin_to"),
            "n_rows",
        )
    )


def box_stats(df: DataFrame, metric: str, group_col: str = "is_bs") -> DataFrame:
    """Quartiles, whiskers within 1.5 IQR and the number of points outside.

    ``df`` is evaluated once; quartiles and whiskers come from its counted values.
    """
    tallied = exact.tally(df, group_col, [metric])
    on = [exact.GROUP, exact.METRIC]
    quartiles = exact.of_tally(tallied, QUARTILES).select(*on, *QUARTILES)
    x, reach = F.col("value"), (F.col("q3") - F.col("q1")) * 1.5
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    return (
        join_checked(tallied, quartiles, on)
        .groupBy(F.col(exact.GROUP).alias(group_col), *QUARTILES)
        .agg(
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("c"))).alias("n_outliers"),
        )
    )


def group_size_on_rows(
    df: DataFrame, group_col: str = "is_bs", counted_col: str = "text", out_col: str = "group_size"
) -> DataFrame:
    """Size of the row's group, by a counted table instead of a window.

    A window would sort each whole group in one task.
    """
    sizes = df.groupBy(group_col).agg(F.count(counted_col).alias(out_col))
    return join_checked(df, sizes, group_col, "left")
