"""TF-IDF n-grams and logistic regression (survey M07-M09, X08)."""

from __future__ import annotations

import json
import math
import zlib

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.bounded import small_rows
from corpusloom.functions.lexical import run_lengths
from corpusloom.functions.text import let
from corpusloom.session import materialise

# ---- fixed values -------------------------------------------------------
TERM_WORD = r"[\p{L}\p{N}_]{2,}"
MAX_TERMS = 10_000
# Vectors that a task of the optimiser takes at least.
ROWS_IN_TASK = 1000
# ---- end of fixed values ------------------------------------------------


def term_words(text: Column) -> Column:
    """Lower-cased words of two or more word characters."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM_WORD), F.lit(0)
    )


def _with_pairs(words: Column) -> Column:
    pairs = F.when(
        F.size(words) > 1,
        F.zip_with(
            F.slice(words, F.lit(1), F.size(words) - 1),
            F.slice(words, F.lit(2), F.size(words) - 1),
            lambda a, b: F.concat_ws(" ", a, b),
        ),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def terms(text: Column) -> Column:
    """Words, then pairs of neighbouring words."""
    return let(term_words(text), _with_pairs)


# The same expression as text, so that a saved model carries it.
_TERMS_SQL = (
    "SELECT *, element_at(transform(array(regexp_extract_all(lower(coalesce({text}, '')), "
    r"'[\\p{{L}}\\p{{N}}_]{{2,}}', 0)), w -> concat(w, if(size(w) > 1, "
    "zip_with(slice(w, 1, size(w) - 1), slice(w, 2, size(w) - 1), "
    "(a, b) -> concat_ws(' ', a, b)), cast(array() as array<string>)))), 1) AS _terms "
    "FROM __THIS__"
)


def _counted(text: Column) -> Column:
    """An array of ``(term, tf)`` by term, counted within the row; null without terms."""

    def counts(ordered: Column) -> Column:
        return F.when(
            F.size(ordered) > 0,
            F.zip_with(
                F.array_distinct(ordered),
                run_lengths(ordered),
                lambda term, n: F.struct(term.alias("term"), n.cast("long").alias("tf")),
            ),
        )

    return let(F.sort_array(terms(text)), counts)


def term_counts(df: DataFrame, text_col: str = "text", id_col: str = "row_id") -> DataFrame:
    """``(row_id, term, tf)``, counted within the row: no shuffle."""
    return df.select(id_col, F.inline(_counted(F.col(text_col))))


def vocabulary(counted: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """Most frequent terms over the corpus with their document frequency."""
    return (
        counted.groupBy("term")
        .agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
        .orderBy(F.desc("total"), "term")
        .limit(max_terms)
    )


def _smooth(df: Column | int, n: int) -> Column:
    return F.ln(F.lit(n + 1.0) / (df + F.lit(1))) + 1


def _look_up(idf: dict[str, float]):
    """The weight of a term, by maps of a few terms each; null for other terms."""
    maps: list[dict[str, float]] = [{} for _ in range(max(1, len(idf) // 2))]
    for term, weight in idf.items():
        maps[zlib.crc32(term.encode()) % len(maps)][term] = weight
    # one literal, worked out once when the query is planned
    table = F.from_json(F.lit(json.dumps(maps)), "array<map<string,double>>")

    def weight(term: Column) -> Column:
        at = (F.crc32(term.cast("binary")) % len(maps)).cast("int")
        return F.try_element_at(F.get(table, at), term)

    return weight


def tfidf_table(
    df: DataFrame, text_col: str = "text", id_col: str = "row_id", max_terms: int = MAX_TERMS
) -> DataFrame:
    """M07 as relations: ``(row_id, term, tf, weight)`` with smooth idf, unit length.

    Texts are taken apart once, into a written array of counts for each row.  Weights and
    their length are worked out within the row from one vocabulary, so what is shuffled
    is the vocabulary alone.  A vocabulary beyond the bound of ``bounded`` is joined.
    """
    rows = materialise(df.select(id_col, _counted(F.col(text_col)).alias("_counts")), "term-counts")
    postings = rows.select(id_col, F.inline("_counts"))
    n = rows.count()
    chosen = materialise(vocabulary(postings, max_terms).select("term", _smooth(F.col("df"), n).alias("idf")), "terms")
    few = small_rows(chosen)
    if few is None:
        raw = postings.join(chosen, "term").withColumn("raw", F.col("tf") * F.col("idf"))
        # a row's terms meet in one group, which is as large as the row's text
        squares = F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(id_col))
        return raw.select(id_col, "term", "tf", (F.col("raw") / F.sqrt(squares)).alias("weight"))
    weight = _look_up({r["term"]: r["idf"] for r in few})

    def raw_weight(c: Column) -> Column:
        return F.struct(c["term"].alias("term"), c["tf"].alias("tf"), (c["tf"] * weight(c["term"])).alias("raw"))

    def scaled(found: Column) -> Column:
        length = F.sqrt(F.aggregate(found, F.lit(0.0), lambda total, x: total + x["raw"] * x["raw"]))
        return let(
            length,
            lambda v: F.transform(
                found, lambda x: F.struct(x["term"].alias("term"), x["tf"].alias("tf"), (x["raw"] / v).alias("weight"))
            ),
        )

    known = F.filter(F.transform("_counts", raw_weight), lambda x: x["raw"].isNotNull())
    return rows.select(id_col, F.inline(let(known, scaled)))


def fit_features(
    df: DataFrame, text_col: str = "text", max_terms: int = MAX_TERMS
) -> PipelineModel:
    """M07 as Spark ML stages: counts, idf + 1, unit length."""
    split_terms = SQLTransformer(statement=_TERMS_SQL.format(text=text_col))
    if max_terms < 1:
        raise ValueError("max_terms must be positive")
    # one vocabulary for the table and the model: ties go to the smaller term
    numbered = df.select(F.monotonically_increasing_id().alias("row_id"), text_col)
    listed = vocabulary(term_counts(numbered, text_col), max_terms).collect()
    counter = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in listed], inputCol="_terms", outputCol="_tf"
    )
    # the vocabulary knows in how many rows its terms are
    n = df.count()
    scale = ElementwiseProduct(
        scalingVec=Vectors.dense([math.log((n + 1) / (r["df"] + 1)) + 1 for r in listed]),
        inputCol="_tf", outputCol="_tfidf",
    )
    unit = Normalizer(inputCol="_tfidf", outputCol="features", p=2.0)
    return PipelineModel(stages=[split_terms, counter, scale, unit])


def fit_classifier(
    featured: DataFrame, label_col: str = "is_bs", max_iter: int = 1000, c: float = 1.0
) -> Transformer:
    """M08 on vectors: L2 with strength 1 / (n * c), no standardisation."""
    n = featured.count()
    # a pass for each iteration: tasks of a few rows cost more than they save
    featured = featured.coalesce(max(1, math.ceil(n / ROWS_IN_TASK)))
    return LogisticRegression(
        featuresCol="features",
        labelCol=label_col,
        maxIter=max_iter,
        regParam=1.0 / (max(n, 1) * c),
        elasticNetParam=0.0,
        standardization=False,
    ).fit(featured)


def fit_baseline(
    train: DataFrame,
    text_col: str = "text",
    label_col: str = "is_bs",
    max_terms: int = MAX_TERMS,
    max_iter: int = 1000,
    c: float = 1.0,
) -> PipelineModel:
    """Features and classifier as one model that takes the text column."""
    features = fit_features(train, text_col, max_terms)
    # the optimiser reads the vectors once per iteration, the texts only now
    vectored = materialise(features.transform(train).select("features", label_col), "tfidf")
    vectored.persist()
    try:
        classifier = fit_classifier(vectored, label_col, max_iter, c)
    finally:
        vectored.unpersist()
    return PipelineModel(stages=[*features.stages, classifier])


def term_weights(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``(term, weight)``; as many rows as the vocabulary, which is capped."""
    terms_list, weights = model.stages[1].vocabulary, model.stages[-1].coefficients.toArray()
    return df.sparkSession.createDataFrame(
        [(t, float(w)) for t, w in zip(terms_list, weights)], "term string, weight double"
    )


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with ``prediction`` and ``probability`` as plain columns."""
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        F.col("prediction").cast("int").alias("prediction"),
        vector_to_array("probability").alias("probability"),
        vector_to_array("rawPrediction").alias("logits"),
    )
