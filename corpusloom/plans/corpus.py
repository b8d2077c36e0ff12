"""Build the corpus from news tables, web pages and feeds."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as tx, urls
from corpusloom.operators import filters, unions
from corpusloom.schemas import CORPUS
from corpusloom.sources import feeds, pages as web

SOURCES = 3  # news, pages, feeds: each gets its own residue class of row ids


def _row_id(id_col, source_no: int):
    return id_col.cast("long") * SOURCES + source_no


def news_rows(
    fake: DataFrame, true: DataFrame, source: str = "news", id_col: str = "row_id"
) -> DataFrame:
    """Labelled news: unattributed negatives dropped, agency lines stripped."""
    both = unions.labelled_union(fake, true)
    kept = filters.drop_unattributed_negatives(both)
    return kept.select(
        # the two tables may number their rows alike
        _row_id(F.col(id_col) * 2 + (1 - F.col("is_bs")), 0).alias("row_id"),
        tx.strip_dateline(F.col("text")).alias("text"),
        "is_bs",
        F.lit(source).alias("source"),
        F.lit(None).cast("string").alias("source_detail"),
    )


def page_rows(
    pages: DataFrame,
    bs_entries: Iterable[Mapping],
    legit_entries: Iterable[Mapping],
    samples_per_domain: int,
    max_words: int = 500,
) -> DataFrame:
    """Articles of listed domains; both lists are searched in one pass."""
    entries = [dict(e, label=1) for e in bs_entries] + [dict(e, label=0) for e in legit_entries]
    if not entries:
        raise ValueError("no domains listed")
    found = web.match_index(pages, entries, samples_per_domain)
    return web.extract_articles(found, max_words).select(
        _row_id(F.col("page_id") * len(entries) + F.col("entry_no"), 1).alias("row_id"),
        "text",
        F.col("label").alias("is_bs"),
        F.lit("CC-index").alias("source"),
        urls.origin_tag(F.col("domain")).alias("source_detail"),
    )


def feed_rows(legit: DataFrame, bs: DataFrame, max_articles: int = 1000) -> DataFrame:
    """Feed articles labelled by the list their feed is on."""
    # entry ids are any text and unique within a feed only: 60 bits of a digest
    # both may be missing; title, date and text then tell entries apart
    parts = ["feed", "entry_id", "url", "title", "date", "text"]
    spelled = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("~")) for c in parts]
    digest = F.md5(F.concat_ws("|", *spelled))
    entry = F.conv(F.substring(digest, 1, 15), 16, 10)
    labelled = unions.labelled_union(
        feeds.feed_articles(bs, max_articles), feeds.feed_articles(legit, max_articles)
    )
    return labelled.select(
        _row_id(entry, 2).alias("row_id"),
        "text",
        "is_bs",
        F.lit("RSS").alias("source"),
        F.col("feed").alias("source_detail"),
    )


def build_corpus(
    spark, inputs: Mapping, audit_path: str | None = None
) -> tuple[DataFrame, dict[str, str]]:
    """The union of the sources that can be read to their end, and why others could not be.

    ``inputs`` maps a source name to a frame or to a function that makes one.  Rows and
    errors of all sources are appended to the table at ``audit_path``, if given.
    """
    detailed = T.StructType([*CORPUS.fields, T.StructField("source_detail", T.StringType())])
    merged, audit = unions.union_committed(spark, inputs, detailed)
    if audit_path is not None:
        audit.coalesce(1).write.mode("append").parquet(audit_path)
    # a row for each source
    return merged, {r["step"]: r["error"] for r in audit.where("error IS NOT NULL").collect()}
