"""Filters, projections and column checks (survey P01-P16)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.bounded import join_checked
from corpusloom.functions import lexical, text as tx, urls
from corpusloom.schemas import require

MAX_INLINE_HOSTS = 10_000


def keep(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns."""
    return require(df, *columns).select(*columns)


def tag(df: DataFrame, **literals) -> DataFrame:
    """Literal columns."""
    return df.withColumns({name: F.lit(value) for name, value in literals.items()})


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Drop columns; names that are not there are ignored."""
    return df.drop(*columns)


def copy_column(df: DataFrame, source: str, target: str) -> DataFrame:
    """Copy or overwrite a column."""
    return require(df, source).withColumn(target, F.col(source))


def is_unattributed_negative(
    text_col: str = "text", label_col: str = "is_bs", marker: str = tx.DATELINE_MARKER
) -> Column:
    return (F.col(label_col) == 0) & ~F.contains(F.col(text_col), F.lit(marker))


def drop_unattributed_negatives(
    df: DataFrame,
    text_col: str = "text",
    label_col: str = "is_bs",
    marker: str = tx.DATELINE_MARKER,
) -> DataFrame:
    """Label-0 rows must carry the agency marker; label-1 rows stay."""
    return df.filter(~is_unattributed_negative(text_col, label_col, marker))


def contains(df: DataFrame, column: str, target: str) -> DataFrame:
    """Plain substring filter."""
    return df.filter(F.contains(F.col(column), F.lit(target)))


def longer_than(df: DataFrame, chars: int = 200, text_col: str = "text") -> DataFrame:
    """Strictly more than ``chars`` characters."""
    return df.filter(F.char_length(text_col) > chars)


def words_between(
    df: DataFrame, min_tokens: int = 0, max_tokens: int | None = None, text_col: str = "text"
) -> DataFrame:
    """White-space word count within the bounds, both included."""
    if max_tokens is None:
        raise ValueError("max_tokens must be given")
    return df.filter(
        tx.text_length(F.col(text_col), "words").between(min_tokens, max_tokens)
    )


def drop_blank(df: DataFrame, text_col: str = "text") -> DataFrame:
    """No null, empty or white-space-only text."""
    return df.filter(~tx.is_blank(F.col(text_col)))


def label_violations(df: DataFrame, label_col: str = "labels", num_labels: int = 2) -> DataFrame:
    """P10 as a report: labels outside ``0..num_labels-1`` with their row counts."""
    return (
        df.filter(F.col(label_col).isNull() | ~F.col(label_col).between(0, num_labels - 1))
        .groupBy(F.col(label_col).alias("label"))
        .agg(F.count("*").alias("n_rows"))
    )


def enforce_labels(
    df: DataFrame,
    label_col: str = "labels",
    num_labels: int = 2,
    names: list[str] | None = None,
    name_col: str | None = None,
) -> DataFrame:
    """P10 as a guard: a label outside the domain fails the job; names are optional."""
    names = names or [str(i) for i in range(num_labels)]
    if len(names) != num_labels:
        raise ValueError(f"{num_labels} labels need {num_labels} names, got {names}")
    label = F.col(label_col)
    out = df.withColumn(
        label_col,
        F.when(label.between(0, num_labels - 1), label).otherwise(
            F.raise_error(F.concat(F.lit("label out of domain: "), label.cast("string")))
        ),
    )
    if name_col:
        shown = F.array(*[F.lit(n) for n in names])
        out = out.withColumn(name_col, F.element_at(shown, F.col(label_col) + 1))
    return out


def balanced_topics(
    topics: DataFrame, low: float = 0.4, high: float = 0.6, outlier: int | None = -1
) -> DataFrame:
    """P11 on the topic table: label share within the band, outlier topic left out."""
    kept = topics.filter(F.col("fake_ratio").between(low, high))
    return kept if outlier is None else kept.filter(F.col("topic") != outlier)


def host_in(
    df: DataFrame, hosts: Iterable[str] | DataFrame, url_col: str = "url"
) -> DataFrame:
    """The URL's host is in the set; a malformed URL is not.

    A list goes into the scan as a hash set; a table ``(host)`` is joined.
    """
    if not isinstance(hosts, DataFrame):
        listed = urls.normalise_hosts(hosts)
        if len(listed) <= MAX_INLINE_HOSTS:
            return df.filter(F.coalesce(urls.url_host(F.col(url_col)).isin(listed), F.lit(False)))
        hosts = df.sparkSession.createDataFrame([(h,) for h in listed], "host string")
    wanted = hosts.select(urls.normalise_host(F.col("host")).alias("_host")).distinct()
    return join_checked(
        df.withColumn("_host", urls.url_host(F.col(url_col))), wanted, "_host", "left_semi"
    ).drop("_host")


def in_categories(df: DataFrame, column: str, categories: Iterable[str]) -> DataFrame:
    """Value is one of the categories."""
    return df.filter(F.col(column).isin(list(categories)))


def null_profile(df: DataFrame) -> DataFrame:
    """Nulls per column and the row count, from one pass."""
    counted = df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n_{i}") for i, c in enumerate(df.columns)],
    )
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("n_nulls"))
            for i, c in enumerate(df.columns)
        ]
    )
    return counted.select("n_rows", F.inline(pairs)).select("column_name", "n_nulls", "n_rows")


def filter_in_place(df: DataFrame, condition: Column) -> DataFrame:
    """A filter that stays where it is written.

    The optimizer moves a cheap predicate down to the scan, which is right; one
    that costs more than the join or repartition it would pass under is better
    evaluated after it.  A generator keeps its place.
    """
    return df.select("*", F.explode(F.when(condition, F.array(F.lit(True)))).alias("_kept")).drop(
        "_kept"
    )


def lexically_diverse(
    df: DataFrame, threshold: float = 0.7, text_col: str = "text"
) -> DataFrame:
    """Keep rows whose HD-D reaches the threshold; only HD-D is computed."""
    return filter_in_place(df, lexical.hdd(F.col(text_col)) >= threshold)
