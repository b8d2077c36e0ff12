"""Batch scoring and user code hooks (survey M10, Y01, Y02)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import scores
from corpusloom.models import baseline
from corpusloom.schemas import SCORE


def score_with_model(
    model: PipelineModel, df: DataFrame, text_col: str = "text", out_col: str = "prediction"
) -> DataFrame:
    """M10 for a Spark ML model: all class scores as a list column."""
    scored = baseline.predict(model, df.drop(out_col))
    listed = F.transform(
        F.col("probability"),
        lambda p, i: F.struct(i.cast("string").alias("label"), p.alias("score")),
    )
    return scored.select(*[c for c in df.columns if c != out_col], listed.alias(out_col))


def score_with_function(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], list]],
    text_col: str = "text",
    out_col: str = "prediction",
) -> DataFrame:
    """M10 for a Python model: ``load`` runs once per task, then whole Arrow batches.

    The loaded function returns per text a label/score mapping or a list of them.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(SCORE))])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            answers = model(frame[text_col].tolist())
            listed = [a if isinstance(a, list) else [a] for a in answers]
            yield frame.assign(
                **{
                    out_col: [
                        [{"label": str(p["label"]), "score": p.get("score")} for p in row]
                        for row in listed
                    ]
                }
            )

    return df.mapInPandas(batches, schema)


def label_outputs(
    scored: DataFrame,
    text_col: str = "text",
    id_col: str = "row_id",
    pred_col: str = "prediction",
    out_col: str = "is_bs",
) -> tuple[DataFrame, DataFrame]:
    """The two outputs: (id, text, label) and (id, text, label, score)."""
    best = scores.normalise_scores(scored, pred_col).withColumn(
        "_best", scores.best_score(F.col(pred_col))
    )
    full = best.select(
        id_col,
        text_col,
        F.col("_best.label").alias(out_col),
        F.col("_best.score").alias("score"),
    )
    return full.drop("score"), full


def apply_text(
    df: DataFrame,
    fn: Callable[[str | None], object],
    text_col: str = "text",
    out_col: str = "result",
    return_type: str = "string",
) -> DataFrame:
    """A user function over a text column, in Arrow batches."""

    @F.pandas_udf(return_type)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fn)

    return df.withColumn(out_col, run(F.col(text_col)))


def apply_rows(
    df: DataFrame, fn: Callable[[dict], object], out_col: str = "result", return_type: str = "string"
) -> DataFrame:
    """A user function over whole rows, in Arrow batches."""
    added = T.StructType.fromDDL(f"`{out_col}` {return_type}")
    schema = T.StructType([*df.schema.fields, *added.fields])

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{out_col: [fn(r) for r in frame.to_dict("records")]})

    return df.mapInPandas(batches, schema)


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """A user function over batches of rows."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield fn(frame)

    return df.mapInPandas(batches, schema)
