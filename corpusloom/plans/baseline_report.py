"""Split, fit the baseline, and report on the held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.models import baseline
from corpusloom.operators import evaluation, sampling, windows
from corpusloom.session import materialise, spread


def baseline_report(
    df: DataFrame,
    label_col: str = "is_bs",
    test_ratio: float = 0.2,
    max_terms: int = baseline.MAX_TERMS,
    max_iter: int = 1000,
) -> dict[str, DataFrame]:
    split = materialise(
        sampling.stratified_split(
            df.select("row_id", "text", label_col), 1 - test_ratio, test_ratio, [label_col]
        ),
        "baseline-split",
        ["split"],
    )
    train = spread(split.filter(F.col("split") == "train").drop("split"), "row_id")
    test = split.filter(F.col("split") == "test").drop("split")
    model = baseline.fit_baseline(
        train, label_col=label_col, max_terms=max_terms, max_iter=max_iter
    )
    scored = materialise(
        baseline.predict(model, test).select("row_id", label_col, "prediction"), "baseline-scored"
    )
    top, bottom = windows.extremes(baseline.term_weights(model, df))
    return {
        "report": evaluation.classification_report(scored, label_col, "prediction"),
        "confusion": evaluation.confusion_matrix(scored, label_col, "prediction"),
        "top_terms": top,
        "bottom_terms": bottom,
    }
