"""Exact quantiles of many groups at once (survey A03, A15).

Rows become (group, metric, value, count).  A span is a stretch of the values of a
group and metric in which wanted ranks lie, at first all of them.  A span of many
values is cut at sampled values, the rows of each part are counted, and only the
parts that hold a wanted rank are spans of the next turn.  Cuts follow the values
wherever they crowd, so a column may be as skewed as it likes; counts are exact, so
is the answer.  What is ranked in one task is a span of at most ``LEAF`` values.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.bounded import join_checked
from corpusloom.functions.columns import let
from corpusloom.session import materialise

# Different values that one task may rank, and parts that a larger span is cut into.
LEAF = 1 << 16
PARTS = 32
GROUP, METRIC = "_group", "_metric"
SPAN = [GROUP, METRIC, "_lo"]


def long_rows(df: DataFrame, group_col: str, metrics: Iterable[str]) -> DataFrame:
    """``(_group, _metric, value)`` of all values that are there, of rows that have a group."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias(METRIC), F.col(m).cast("double").alias("value")) for m in metrics]
    )
    return (
        df.filter(F.col(group_col).isNotNull())
        .select(F.col(group_col).alias(GROUP), F.inline(pairs))
        .filter(F.col("value").isNotNull())
    )


def tally(df: DataFrame, group_col: str, metrics: Iterable[str]) -> DataFrame:
    """Written ``(_group, _metric, value, c)``; ``df`` is evaluated for it once."""
    counted = long_rows(df, group_col, metrics).groupBy(GROUP, METRIC, "value").agg(F.count("*").alias("c"))
    return materialise(counted, "tally")


def _rank(q: float, up: bool) -> Column:
    """The rank (from 0) at or below a quantile of ``n`` rows, or the one at or above it."""
    at = F.lit(float(q)) * (F.col("n") - 1)
    return (F.ceil(at) if up else F.floor(at)).cast("long")


def _inside(counted: DataFrame) -> DataFrame:
    """Rows ``(_lo, value, c)`` of spans, with the rows before them: all of the group and metric."""
    before = F.sum("c").over(Window.partitionBy(*SPAN).orderBy("value")) - F.col("c")
    return counted.withColumn("_before", F.col("_before") + before)


def _held(c: Column) -> Column:
    """The wanted ranks among ``c`` rows behind ``_before`` others."""
    return F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + c))


def _cut(values: DataFrame) -> DataFrame:
    """The parts of too large spans that hold wanted ranks, as spans."""
    shares = F.array(*[F.lit(i / PARTS) for i in range(1, PARTS)])
    # where to cut is a matter of speed only
    cuts = values.groupBy(*SPAN).agg(F.percentile_approx("value", shares, F.lit(1000)).alias("_cuts"))
    part = sum((F.col("value") >= F.col("_cuts")[i]).cast("int") for i in range(PARTS - 1))
    counted = (
        join_checked(values, cuts, SPAN)
        .groupBy(*SPAN, part.alias("_part"))
        .agg(
            F.sum("c").alias("c"), F.count("*").alias("_values"), F.min("value").alias("value"),
            F.max("value").alias("_new_hi"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"),
        )
    )
    return _inside(counted).select(
        GROUP, METRIC, F.col("value").alias("_lo"), F.col("_new_hi").alias("_hi"), "_before",
        _held(F.col("c")).alias("_ranks"), "_values",
    ).where(F.size("_ranks") > 0)


def of_tally(tallied: DataFrame, quantiles: Mapping[str, float]) -> DataFrame:
    """``(_group, _metric, n, min, max)`` and a column for each quantile, interpolated between ranks."""
    total = materialise(
        tallied.groupBy(GROUP, METRIC).agg(
            F.sum("c").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
            F.count("*").alias("_values"),
        ),
        "tally-totals",
    )
    ranks = F.array_distinct(F.array(*[_rank(q, up) for q in quantiles.values() for up in (False, True)]))
    spans = total.select(
        GROUP, METRIC, F.col("min").alias("_lo"), F.col("max").alias("_hi"),
        F.lit(0).cast("long").alias("_before"), ranks.alias("_ranks"), "_values",
    )
    leaves = spans.where(F.col("_values") <= LEAF)
    large = spans.where(F.col("_values") > LEAF)
    while not large.isEmpty():
        parts = materialise(_cut(_values_of(tallied, large)), "spans")
        leaves = leaves.unionByName(parts.where(F.col("_values") <= LEAF))
        large = parts.where(F.col("_values") > LEAF)
    ranked = _inside(_values_of(tallied, leaves))
    at = ranked.select(GROUP, METRIC, "value", F.explode(_held(F.col("c"))).alias("_rank"))
    found = at.groupBy(GROUP, METRIC).agg(
        F.map_from_entries(F.collect_list(F.struct("_rank", "value"))).alias("_at")
    )

    def quantile(q: float) -> Column:
        exact = F.lit(float(q)) * (F.col("n") - 1)
        low, high = F.col("_at")[_rank(q, False)], F.col("_at")[_rank(q, True)]
        return let(low, lambda v: F.when(high == v, v).otherwise(v + (high - v) * (exact - F.floor(exact))))

    return total.join(found, [GROUP, METRIC]).select(
        GROUP, METRIC, "n", "min", "max", *[quantile(q).alias(name) for name, q in quantiles.items()]
    )


def _values_of(tallied: DataFrame, spans: DataFrame) -> DataFrame:
    inside = join_checked(tallied, spans.drop("_values"), [GROUP, METRIC])
    return inside.where(F.col("value").between(F.col("_lo"), F.col("_hi")))
