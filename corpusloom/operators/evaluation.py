"""Classifier evaluation as SQL over small count tables (survey A07-A09, M12, M13)."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions import scores

EPS = sys.float_info.epsilon


def confusion_counts(
    df: DataFrame, actual: str, predicted: str, by: list[str] | None = None
) -> DataFrame:
    """Rows per (actual, predicted): everything below is derived from this."""
    return df.groupBy(
        *(by or []), F.col(actual).alias("actual"), F.col(predicted).alias("predicted")
    ).agg(F.count("*").alias("n_rows"))


def confusion_matrix(
    df: DataFrame, actual: str, predicted: str, labels: list[int] | None = None
) -> DataFrame:
    """One row per actual label, one column ``pred_<label>`` per prediction."""
    labels = list(labels or [0, 1])
    cells = [
        F.coalesce(
            F.sum(F.when(F.col("predicted") == value, F.col("n_rows"))), F.lit(0)
        ).alias(f"pred_{value}")
        for value in labels
    ]
    counted = confusion_counts(df, actual, predicted).groupBy("actual").agg(*cells)
    domain = df.sparkSession.createDataFrame([(v,) for v in labels], "actual int")
    return domain.join(counted, "actual", "left").fillna(0)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_scores(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support per class; nothing to divide by gives 0.

    ``counts`` is the confusion table, so classes that only occur in one of the
    two columns still get a row.
    """
    by = by or []
    sides = F.array(
        F.struct(
            F.col("actual").alias("label"),
            F.col("n_rows").alias("support"),
            F.lit(0).cast("long").alias("claimed"),
            F.when(F.col("actual") == F.col("predicted"), F.col("n_rows")).otherwise(0).alias("hit"),
        ),
        F.struct(
            F.col("predicted").alias("label"),
            F.lit(0).cast("long").alias("support"),
            F.col("n_rows").alias("claimed"),
            F.lit(0).cast("long").alias("hit"),
        ),
    )
    per_class = (
        counts.select(*by, F.inline(sides))
        .groupBy(*by, "label")
        .agg(
            F.sum("support").alias("support"),
            F.sum("claimed").alias("claimed"),
            F.sum("hit").alias("hit"),
        )
    )
    p, r = _ratio(F.col("hit"), F.col("claimed")), _ratio(F.col("hit"), F.col("support"))
    return (
        per_class.withColumn("precision", p)
        .withColumn("recall", r)
        .withColumn(
            "f1",
            _ratio(
                F.lit(2.0) * F.col("precision") * F.col("recall"),
                F.col("precision") + F.col("recall"),
            ),
        )
    )


def classification_report(
    df: DataFrame, actual: str, predicted: str, digits: int = 2
) -> DataFrame:
    """A row per class, then accuracy, macro and weighted averages.

    The accuracy row repeats accuracy in all score columns and carries the
    total support.
    """
    per_class = class_scores(confusion_counts(df, actual, predicted))
    measures = ["precision", "recall", "f1"]
    rounded = [F.round(m, digits).alias(m) for m in measures]
    classes = per_class.select(
        F.col("label").cast("string").alias("name"), *rounded, F.col("support")
    )
    n = F.sum("support")
    totals = per_class.agg(
        *[F.avg(m).alias(f"macro_{m}") for m in measures],
        *[(F.sum(F.col(m) * F.col("support")) / n).alias(f"weighted_{m}") for m in measures],
        (F.sum("hit") / n).alias("accuracy"),
        n.alias("support"),
    )
    summary = F.array(
        F.struct(
            F.lit("accuracy").alias("name"),
            *[F.col("accuracy").alias(m) for m in measures],
            F.col("support"),
        ),
        *[
            F.struct(
                F.lit(f"{kind} avg").alias("name"),
                *[F.col(f"{kind}_{m}").alias(m) for m in measures],
                F.col("support"),
            )
            for kind in ("macro", "weighted")
        ],
    )
    return classes.unionByName(
        totals.select(F.inline(summary)).select("name", *rounded, "support")
    )


METRICS = ("accuracy", "precision_macro", "recall_macro", "f1_macro", "log_loss")


def logit_metrics(
    df: DataFrame,
    logits: str = "logits",
    label: str = "labels",
    by: list[str] | None = None,
) -> DataFrame:
    """Accuracy, macro precision/recall/F1 and log loss, per group if asked.

    The loss is summed in the same grouping as the confusion counts, so the
    rows are read once.
    """
    by = by or []
    probs = scores.softmax(F.col(logits))
    chance = F.element_at(probs, F.col(label) + 1)
    loss = -F.ln(F.least(F.greatest(chance, F.lit(EPS)), F.lit(1 - EPS)))
    counts = (
        df.select(
            *by,
            F.col(label).alias("actual"),
            scores.argmax(F.col(logits)).alias("predicted"),
            loss.alias("loss"),
        )
        .groupBy(*by, "actual", "predicted")
        .agg(F.count("*").alias("n_rows"), F.sum("loss").alias("loss"))
    )
    macro = (
        class_scores(counts, by)
        .groupBy(*by)
        .agg(
            (F.sum("hit") / F.sum("support")).alias("accuracy"),
            F.avg("precision").alias("precision_macro"),
            F.avg("recall").alias("recall_macro"),
            F.avg("f1").alias("f1_macro"),
        )
    )
    losses = counts.groupBy(*by).agg((F.sum("loss") / F.sum("n_rows")).alias("log_loss"))
    if by:
        return macro.join(losses, by)
    pair = losses.scalar()
    return macro.withColumn("log_loss", pair)


def metrics_long(metrics: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """One row per set and metric, the metric named ``<set>_<metric>``."""
    pairs = F.array(
        *[F.struct(F.lit(m).alias("m"), F.col(m).alias("value")) for m in METRICS]
    )
    return metrics.select(dataset_col, F.inline(pairs)).select(
        dataset_col,
        F.concat_ws("_", F.col(dataset_col), F.col("m")).alias("metric"),
        "value",
    )


def best_run(
    metrics: DataFrame,
    patience: int = 2,
    score: str = "f1_macro",
    step: str = "step",
    group: str = "run",
) -> DataFrame:
    """Per run the best step before ``patience`` steps in a row brought no gain.

    The candidate table is small: one row per run and step.
    """
    earlier = (
        Window.partitionBy(group).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    )
    order = Window.partitionBy(group).orderBy(step)
    best_before = F.max(score).over(earlier)
    flagged = (
        metrics.withColumn("_gain", best_before.isNull() | (F.col(score) > best_before))
        .withColumn("_n", F.row_number().over(order))
        .withColumn("_last_gain", F.max(F.when(F.col("_gain"), F.col("_n"))).over(order))
        .withColumn("_stale", F.col("_n") - F.col("_last_gain"))
        .withColumn("_stop", F.max((F.col("_stale") >= patience).cast("int")).over(earlier))
    )
    # steps after the stopping one would not have been run
    return (
        flagged.filter(F.coalesce(F.col("_stop"), F.lit(0)) == 0)
        .groupBy(group)
        .agg(
            F.max_by(step, F.struct(F.col(score), -F.col(step))).alias("best_step"),
            F.max(score).alias(f"best_{score}"),
            F.max(step).alias("last_step"),
        )
    )
