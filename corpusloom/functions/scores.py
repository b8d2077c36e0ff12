"""Score arrays (survey W07, N04 and the softmax of A09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.schemas import SCORE

_SCORES = f"array<{SCORE.simpleString()}>"


def best_score(scores: Column) -> Column:
    """The entry with the highest score; the first one wins a tie."""
    top = F.array_max(
        F.transform(
            scores,
            lambda s, i: F.struct(
                s["score"].alias("score"), (-i).alias("at"), s["label"].alias("label")
            ),
        )
    )
    return F.struct(top["label"].alias("label"), top["score"].alias("score"))


def argmax(logits: Column) -> Column:
    """Index of the largest number, the first on ties."""
    top = F.array_max(
        F.transform(logits, lambda x, i: F.struct(x.alias("x"), (-i).alias("at")))
    )
    return -top["at"]


def softmax(logits: Column) -> Column:
    """Probabilities, shifted by the maximum so that exp cannot overflow."""
    shifted = F.transform(logits, lambda x: F.exp(x - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(shifted, lambda x: x / total)


def normalise_scores(df: DataFrame, col: str = "prediction") -> DataFrame:
    """Bring a prediction column to ``array<struct<label,score>>``.

    Accepted are a list of (label, score), one (label, score) or one (label);
    any other type is an error now, an empty list an error at run time.
    """
    kind = df.schema[col].dataType
    pred = F.col(col)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        names = set(kind.elementType.names)
        if {"label", "score"} <= names:
            listed = F.transform(
                pred, lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score"))
            ).cast(_SCORES)
            return df.withColumn(
                col,
                F.when(F.size(pred) == 0, F.raise_error(F.lit("empty prediction"))).otherwise(
                    listed
                ),
            )
    if isinstance(kind, T.StructType) and "label" in kind.names:
        score = pred["score"] if "score" in kind.names else F.lit(None)
        one = F.struct(
            pred["label"].cast("string").alias("label"), score.cast("double").alias("score")
        )
        return df.withColumn(col, F.array(one).cast(_SCORES))
    raise ValueError(f"unexpected prediction format: {kind.simpleString()}")
