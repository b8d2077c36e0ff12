"""Document vectors, dimension reduction and clustering (survey M02-M04)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.lexical import letter_runs
from corpusloom.models import wide

SEED = 42
# PCA builds a width x width matrix on the driver; wider input goes through ``wide``.
MAX_PCA_WIDTH = 4096


def document_vectors(
    df: DataFrame, text_col: str = "text", out_col: str = "vector", width: int = 256
) -> DataFrame:
    """Hashed TF-IDF vectors of unit length."""
    worded = df.withColumn("_words", letter_runs(F.coalesce(F.col(text_col), F.lit(""))))
    hashed = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=width).transform(worded)
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(hashed).transform(hashed)
    unit = Normalizer(inputCol="_tfidf", outputCol=out_col, p=2.0)
    return unit.transform(weighted).drop("_words", "_tf", "_tfidf")


def as_vector(df: DataFrame, array_col: str, out_col: str = "vector") -> DataFrame:
    """A stored ``array<float>`` column as an ML vector."""
    return df.withColumn(out_col, array_to_vector(F.col(array_col).cast("array<double>")))


def reduce_dimensions(
    df: DataFrame,
    n_components: int = 2,
    in_col: str = "vector",
    out_col: str = "reduced",
) -> DataFrame:
    """Principal components; never more than the vectors are wide.

    Beyond ``MAX_PCA_WIDTH`` they are found by ``wide.principal_directions``, whose
    memory grows with the width, not with its square.
    """
    first = df.filter(F.col(in_col).isNotNull()).select(F.size(vector_to_array(in_col)).alias("w")).first()
    if first is None:
        raise ValueError("no rows to reduce")
    if first["w"] > MAX_PCA_WIDTH:
        directions, _, _ = wide.principal_directions(df, n_components, in_col)
        return wide.project(df, directions, in_col, out_col)
    pca = PCA(k=min(n_components, first["w"]), inputCol=in_col, outputCol=out_col)
    return pca.fit(df).transform(df)


def fit_kmeans(
    df: DataFrame,
    k: int = 2,
    in_col: str = "vector",
    out_col: str = "cluster",
    seed: int = SEED,
    max_iter: int = 300,
) -> KMeansModel:
    return KMeans(
        k=k, seed=seed, featuresCol=in_col, predictionCol=out_col, maxIter=max_iter
    ).fit(df)


def kmeans(
    df: DataFrame,
    k: int = 2,
    in_col: str = "vector",
    out_col: str = "cluster",
    seed: int = SEED,
    max_iter: int = 300,
) -> tuple[DataFrame, KMeansModel]:
    """The frame with a cluster column, and the model."""
    model = fit_kmeans(df, k, in_col, out_col, seed, max_iter)
    return model.transform(df), model


def components(df: DataFrame, vector_col: str = "reduced") -> DataFrame:
    """A vector column spread to an array, for tables and plots."""
    return df.withColumn(vector_col, vector_to_array(vector_col))
