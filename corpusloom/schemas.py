"""Explicit schemas of the tables that move between stages."""

from pyspark.sql import DataFrame
from pyspark.sql import types as T

ENTITY = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("entity_group", T.StringType())]
)
SCORE = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]
)
CORPUS = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("is_bs", T.IntegerType()),
        T.StructField("source", T.StringType()),
    ]
)
ENRICHED = T.StructType(
    CORPUS.fields
    + [T.StructField("entities", T.ArrayType(ENTITY)), T.StructField("topic", T.IntegerType())]
)
TOPICS = T.StructType(
    [
        T.StructField("topic", T.IntegerType()),
        T.StructField("n_label_0", T.LongType()),
        T.StructField("n_label_1", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("fake_ratio", T.DoubleType()),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
LABELLED_ARTICLE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("is_bs", T.IntegerType()),
        T.StructField("source", T.StringType()),
    ]
)
RUN_METRIC = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("step", T.IntegerType()),
        T.StructField("value", T.DoubleType()),
    ]
)
RUN_PARAM = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("param", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
STEP_AUDIT = T.StructType(
    [
        T.StructField("step", T.StringType()),
        T.StructField("rows_in", T.LongType()),
        T.StructField("rows_out", T.LongType()),
        T.StructField("rows_changed", T.LongType()),
    ]
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail at once, with a clear message, when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df
