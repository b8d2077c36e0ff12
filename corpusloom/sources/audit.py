"""Audit tables about steps, runs and datasets (survey K04-K06)."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.schemas import RUN_METRIC, RUN_PARAM


def run_name(experiment: str, now: datetime | None = None) -> str:
    return f"{experiment}_{(now or datetime.now()).strftime('%Y-%m-%d_%H:%M')}"


def step_audit(df: DataFrame, stages: list[tuple[str, Column, Column, Column]]) -> DataFrame:
    """Rows in, out and changed for steps expressed as flags of one frame.

    A stage is (name, came in, went out, was changed); all are counted in one
    aggregate.
    """
    counted = df.agg(
        *[
            F.struct(
                F.lit(name).alias("step"),
                F.count_if(came).alias("rows_in"),
                F.count_if(went).alias("rows_out"),
                F.count_if(changed).alias("rows_changed"),
            ).alias(f"s{i}")
            for i, (name, came, went, changed) in enumerate(stages)
        ]
    )
    return counted.select(
        F.inline(F.array(*[F.col(f"s{i}") for i in range(len(stages))]))
    )


def _numeric(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def log_metrics(
    spark: SparkSession,
    path: str,
    run: str,
    metrics: Mapping[str, object],
    dataset: str = "",
    step: int = 0,
) -> None:
    """Append the numeric metrics of a run; other values are passed over."""
    rows = [
        (run, dataset, name, step, float(value))
        for name, value in metrics.items()
        if _numeric(value)
    ]
    if rows:
        spark.createDataFrame(rows, RUN_METRIC).coalesce(1).write.mode("append").parquet(path)


def log_metric_table(
    metrics: DataFrame, path: str, run: str, names: list[str], dataset_col: str, step: int = 0
) -> None:
    """K05 from a table with one row per dataset; nothing passes through the driver."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    )
    (
        metrics.select(F.col(dataset_col).cast("string").alias("dataset"), F.inline(pairs))
        .select(
            F.lit(run).alias("run"), "dataset", "metric", F.lit(step).alias("step"), "value"
        )
        .filter(F.col("value").isNotNull())
        .write.mode("append")
        .parquet(path)
    )


def log_params(spark: SparkSession, path: str, run: str, params: Mapping[str, object]) -> None:
    """Append parameters as text."""
    rows = [(run, name, str(value)) for name, value in params.items()]
    if rows:
        spark.createDataFrame(rows, RUN_PARAM).coalesce(1).write.mode("append").parquet(path)


def content_fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """Row count and a sum of row hashes, whatever the order of the rows."""
    spelled = F.concat_ws(
        "|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in columns]
    )
    part = F.conv(F.substring(F.md5(spelled), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(
        F.count("*").alias("n_rows"),
        (F.sum(part) % F.lit(10**15).cast("decimal(20,0)")).cast("long").alias("content_print"),
    )
