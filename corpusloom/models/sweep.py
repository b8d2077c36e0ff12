"""Experiment sweep and evaluation on named sets (survey M11-M13)."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.models import baseline
from corpusloom.operators import evaluation
from corpusloom.schemas import RUN_METRIC
from corpusloom.session import materialise
from corpusloom.sources import audit

STATUS = "run string, status string, message string"


def external_evaluation(
    model: PipelineModel,
    sets: Mapping[str, DataFrame],
    text_col: str = "text",
    label_col: str = "is_bs",
) -> DataFrame:
    """All named sets scored in one transform, metrics per set."""
    if not sets:
        raise ValueError("no evaluation sets")
    frames = [
        df.select(text_col, label_col, F.lit(name).alias("dataset")) for name, df in sets.items()
    ]
    scored = baseline.predict(model, reduce(DataFrame.unionByName, frames))
    return evaluation.logit_metrics(scored, "logits", label_col, by=["dataset"])


def run_experiments(
    spark: SparkSession,
    experiments: Mapping[str, Mapping],
    metrics_path: str,
    run_one: Callable[[Mapping], Mapping],
    at_once: int = 4,
) -> DataFrame:
    """Each configuration on its own, some side by side; one failure does not stop the rest.

    ``run_one`` trains and returns metrics: ``{name: value}``, or ``{dataset: {name: value}}``
    for several evaluation sets.  They are appended to the run-metric table; the result
    has a status row per experiment.  The jobs of an experiment are a job group of its
    name in a scheduler pool of their own, so that runs share the executors evenly
    where Spark schedules fairly.
    """

    # appends to one folder exclude each other
    writing = threading.Lock()

    def one(item: tuple[str, Mapping]) -> tuple[str, str, str]:
        name, config = item
        spark.sparkContext.setJobGroup(name, f"experiment {name}")
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"sweep-{name}")
        try:
            metrics = run_one(config)
            nested = metrics if all(isinstance(m, Mapping) for m in metrics.values()) else {"": metrics}
            with writing:
                audit.log_params(spark, f"{metrics_path}/params", name, config)
                for dataset, values in nested.items():
                    audit.log_metrics(spark, f"{metrics_path}/metrics", name, values, dataset)
            return name, "finished", ""
        except Exception as error:  # noqa: BLE001 - any failure is recorded
            return name, "failed", f"{type(error).__name__}: {error}"[:500]

    with ThreadPoolExecutor(max_workers=at_once) as pool:
        status = list(pool.map(inheritable_thread_target(spark)(one), experiments.items()))
    return spark.createDataFrame(status, STATUS)


class SharedFeatures:
    """Features of a training table, fitted and written once for each vocabulary size.

    Runs that ask for the same size at the same time wait for one fit; a fit that
    fails fails every run that asks for it.
    """

    def __init__(self, train: DataFrame, sets: Mapping[str, DataFrame], label_col: str = "is_bs"):
        self.train, self.label_col = train, label_col
        named = [
            df.select("text", label_col, F.lit(name).alias("dataset")) for name, df in sets.items()
        ]
        if not named:
            raise ValueError("no evaluation sets")
        self.evaluated = reduce(DataFrame.unionByName, named)
        self._lock, self._fits = threading.Lock(), {}

    def of(self, max_terms: int) -> tuple[DataFrame, DataFrame]:
        """The vectors of the training rows, and those of all evaluation sets."""
        with self._lock:
            fit = self._fits.setdefault(max_terms, Future())
            mine = not fit.running() and not fit.done() and fit.set_running_or_notify_cancel()
        if mine:
            try:
                fit.set_result(self._fit(max_terms))
            except Exception as error:  # noqa: BLE001 - handed on to every run that waits
                fit.set_exception(error)
        return fit.result()

    def _fit(self, max_terms: int) -> tuple[DataFrame, DataFrame]:
        model = baseline.fit_features(self.train, max_terms=max_terms)
        fitted = model.transform(self.train).select("features", self.label_col)
        held = model.transform(self.evaluated).select("features", self.label_col, "dataset")
        return materialise(fitted, "sweep-train"), materialise(held, "sweep-sets")

    def train_and_evaluate(self, config: Mapping) -> dict[str, dict[str, float]]:
        """One run: a classifier on the shared features, metrics of each evaluation set."""
        fitted, held = self.of(config.get("max_terms", baseline.MAX_TERMS))
        fitted = fitted.persist()
        try:
            model = baseline.fit_classifier(
                fitted, self.label_col, config.get("max_iter", 1000), config.get("c", 1.0)
            )
        finally:
            fitted.unpersist()
        scored = baseline.predict(model, held)
        rows = evaluation.logit_metrics(scored, "logits", self.label_col, by=["dataset"]).collect()
        return {r["dataset"]: {m: r[m] for m in evaluation.METRICS} for r in rows}


def run_metrics(spark: SparkSession, metrics_path: str) -> DataFrame:
    """``(run, dataset, metric, step, value)`` of all runs that finished."""
    return spark.read.schema(RUN_METRIC).parquet(f"{metrics_path}/metrics")


def iteration_ladder(
    train: DataFrame,
    test: DataFrame,
    ladder: list[int],
    patience: int = 2,
    max_terms: int = baseline.MAX_TERMS,
    label_col: str = "is_bs",
) -> tuple[PipelineModel, DataFrame]:
    """Grow the iterations, stop after ``patience`` steps without a better F1.

    Features are fitted once; the best model is returned with the step table.
    """
    features = baseline.fit_features(train, max_terms=max_terms)
    fitted = materialise(features.transform(train).select("features", label_col), "ladder-train")
    held = materialise(features.transform(test).select("features", label_col), "ladder-test")
    best, best_score, stale, rows = None, None, 0, []
    for step, max_iter in enumerate(ladder):
        model = baseline.fit_classifier(fitted, label_col, max_iter)
        row = evaluation.logit_metrics(baseline.predict(model, held), "logits", label_col).first()
        score = row["f1_macro"]
        rows.append(("ladder", step, max_iter, float(score)))
        if best_score is None or score > best_score:
            best, best_score, stale = model, score, 0
        else:
            stale += 1
            if stale >= patience:
                break
    table = train.sparkSession.createDataFrame(
        rows, "run string, step int, max_iter int, f1_macro double"
    )
    return PipelineModel(stages=[*features.stages, best]), table
