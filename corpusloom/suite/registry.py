"""Query registry and the tables the queries start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import spread

_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver tables of one folder, and the labelled corpus made from them."""

    def __init__(self, spark: SparkSession, folder: str, heavy: bool = False):
        self.spark, self.folder, self.heavy = spark, folder.rstrip("/"), heavy

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if self.heavy and name in _TEXT_TABLES:
            return spread(table, _TEXT_TABLES[name])
        return table

    @property
    def corpus(self) -> DataFrame:
        docs = self.documents.select(
            F.col("doc_id").alias("row_id"), "text", "source", "lang", "n_chars"
        )
        labels = self.labels.select(
            F.col("doc_id").alias("row_id"),
            (1 - F.col("quality")).cast("int").alias("is_bs"),
            "toxic",
        )
        topic = F.when(F.col("lang") == "es", -1).otherwise(
            F.substring("source", 4, 10).cast("int")
        )
        return docs.join(labels, "row_id").withColumn("topic", topic)

    @property
    def news(self) -> DataFrame:
        """The corpus with an agency dateline in front of English and German rows."""
        dated = F.concat(F.lit("CITY (Reuters) - "), F.col("text"))
        return self.corpus.withColumn(
            "text", F.when(F.col("lang").isin("en", "de"), dated).otherwise(F.col("text"))
        )


CORPUS = """corpus AS (
  SELECT d.doc_id AS row_id, d.text, d.source, d.lang, d.n_chars,
         CAST(1 - l.quality AS INTEGER) AS is_bs, l.toxic,
         CASE WHEN d.lang = 'es' THEN -1 ELSE CAST(substr(d.source, 4) AS INTEGER) END AS topic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
NEWS = (
    CORPUS
    + """, news AS (
  SELECT * REPLACE (CASE WHEN lang IN ('en', 'de') THEN 'CITY (Reuters) - ' || text
                         ELSE text END AS text) FROM corpus)"""
)


def query(name: str, sql: str | None = None, heavy: bool = False):
    """Register ``fn(tables) -> DataFrame`` under ``name``.

    ``heavy`` marks queries that spend their time on each text.
    """

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder, heavy))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add
