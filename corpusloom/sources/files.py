"""File sources and sinks (survey S01-S03, S07, K01-K03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CSV = {"header": True, "multiLine": True, "escape": '"', "quote": '"'}


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    encoding: str = "UTF-8",
    index_col: str | None = None,
) -> DataFrame:
    """CSV with a header and quoted, multi-line text.

    ``index_col`` names the leading index column of the file, if it has one.
    """
    reader = spark.read.options(**_CSV, encoding=encoding)
    if index_col:
        declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        schema = T.StructType([T.StructField(index_col, T.LongType()), *declared.fields])
    # columns are matched by position, as the index column has no name
    return reader.options(enforceSchema=True).schema(schema).csv(path)


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """S02."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.parquet(*paths)


def read_json_lines(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    max_rows: int | None = None,
    order_col: str = "row_id",
) -> DataFrame:
    """JSON lines; a row cap keeps the rows with the smallest ids."""
    rows = spark.read.schema(schema).json(path)
    return rows if max_rows is None else rows.orderBy(order_col).limit(max_rows)


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    files_per_batch: int = 1,
    pattern: str = "*.parquet",
) -> DataFrame:
    """An unbounded frame over Parquet files that keep arriving."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("pathGlobFilter", pattern)
        .parquet(folder)
    )


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K01."""
    df.write.mode(mode).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with quotes around every value; nested columns become JSON."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    flat = df.select(
        *[
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in df.schema.fields
        ]
    )
    flat.write.mode(mode).options(header=True, quoteAll=True, escape='"').csv(path)


def write_split(train: DataFrame, test: DataFrame, folder: str, fmt: str = "parquet") -> None:
    """The train and the test table, side by side in one folder."""
    for name, frame in (("train", train), ("test", test)):
        path = f"{folder}/{name}"
        if fmt == "csv":
            write_csv(frame, path)
        else:
            write_parquet(frame, path)
