"""Unions (survey U01-U03)."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from py4j.protocol import Py4JError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.schemas import STEP_AUDIT
from corpusloom.session import work_path


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all frames, columns by name, missing ones null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def labelled_union(
    ones: DataFrame, zeros: DataFrame, label_col: str = "is_bs"
) -> DataFrame:
    """First frame gets label 1, second label 0, by origin."""
    return union_all(ones.withColumn(label_col, F.lit(1)), zeros.withColumn(label_col, F.lit(0)))


def union_available(
    spark: SparkSession,
    inputs: Mapping[str, DataFrame | Callable[[], DataFrame] | None],
    schema: T.StructType,
) -> tuple[DataFrame, dict[str, str]]:
    """Union of the inputs that can be read; the others are reported.

    An input is a frame, a function that makes one, or None.  With no usable
    input the result is an empty frame of ``schema``.  Nothing runs yet, so an input
    that fails while it is read fails the union; see ``union_committed``.
    """
    usable, failed = [], {}
    for name, made in inputs.items():
        try:
            frame = made() if callable(made) else made
            if frame is None:
                raise ValueError("no data")
            usable.append(frame)
        except (PySparkException, ValueError, OSError) as error:
            failed[name] = f"{type(error).__name__}: {error}"[:500]
    if not usable:
        return spark.createDataFrame([], schema), failed
    return _shaped(union_all(*usable), schema), failed


def _shaped(frame: DataFrame, schema: T.StructType) -> DataFrame:
    have = set(frame.columns)
    return frame.select(
        *[
            (F.col(f"`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def union_committed(
    spark: SparkSession,
    inputs: Mapping[str, DataFrame | Callable[[], DataFrame] | None],
    schema: T.StructType,
    at_once: int = 4,
) -> tuple[DataFrame, DataFrame]:
    """Union of the inputs that could be read to their end, and the audit of all.

    Each input is written alone, a few side by side, and counts only once its write is
    committed.  So a corrupt file, a value that does not fit the schema or a failing
    function loses that input as a whole and no other.  The audit has a row for each
    input: ``(step, rows_in, rows_out, rows_changed, error)``, error null if it was taken.
    """
    path = work_path(spark, "union")

    def commit(numbered: tuple[int, str]) -> tuple[str, int, int, int, str | None]:
        no, name = numbered
        try:
            made = inputs[name]
            frame = made() if callable(made) else made
            if frame is None:
                raise ValueError("no data")
            _shaped(frame, schema).write.parquet(f"{path}/{no}")
            rows = spark.read.schema(schema).parquet(f"{path}/{no}").count()
            return name, rows, rows, 0, None
        except (PySparkException, Py4JError, ValueError, OSError) as error:
            return name, 0, 0, 0, f"{type(error).__name__}: {error}"[:500]

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        rows = list(pool.map(inheritable_thread_target(spark)(commit), enumerate(inputs)))
    taken = [f"{path}/{no}" for no, row in enumerate(rows) if row[-1] is None]
    audit = spark.createDataFrame(rows, T.StructType([*STEP_AUDIT.fields, T.StructField("error", T.StringType())]))
    if not taken:
        return spark.createDataFrame([], schema), audit
    return spark.read.schema(schema).parquet(*taken), audit
