"""Feed entries from XML files on storage (survey S04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.bounded import checked
from corpusloom.functions import text as tx, urls
from corpusloom.operators import filters, windows
from corpusloom.sources import pages as web

_ITEM = "link string, title string, pubDate string, description string, guid string"
_ENTRY = (
    "link array<struct<_href:string,_rel:string>>, title string, published string, updated string, "
    "summary string, content string, id string"
)

_MAIL_DATES = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yy HH:mm:ss Z", "d MMM yyyy HH:mm:ss"]


def _reader(spark: SparkSession, row_tag: str, schema: str):
    return (
        spark.read.format("xml")
        .option("rowTag", row_tag)
        .option("ignoreSurroundingSpaces", False)
        .schema(schema)
    )


def _page_link(links):
    """Of an entry's links the alternate one (no relation means that), else the first."""
    pages = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    return F.coalesce(F.try_element_at(pages, F.lit(1)), F.try_element_at(links, F.lit(1)))["_href"]


def entry_time(date):
    """The moment of an RFC 822 or ISO date; null where it is neither."""
    bare = F.regexp_replace(F.trim(date), r"^[A-Za-z]{3,9},?\s+", "")
    offset = F.regexp_replace(bare, r"(GMT|UTC|UT|Z)$", "+0000")
    tries = [F.try_to_timestamp(offset, F.lit(f)) for f in _MAIL_DATES]
    iso = F.when(date.rlike(r"^\s*\d{4}-\d"), F.try_to_timestamp(F.trim(date)))
    return F.coalesce(*tries, iso)


def _feed(by: str):
    """The feed is the file, or the folder its files lie in."""
    at = {"file": -1, "folder": -2}[by]
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), at).alias("feed")


def read_rss(spark: SparkSession, path: str | list[str], feed_by: str = "file") -> DataFrame:
    """Items of RSS files: ``feed, entry_id, url, title, date, text``."""
    return _reader(spark, "item", _ITEM).load(path).select(
        _feed(feed_by),
        F.col("guid").alias("entry_id"),
        F.col("link").alias("url"),
        "title",
        F.col("pubDate").alias("date"),
        F.col("description").alias("text"),
    )


def read_atom(spark: SparkSession, path: str | list[str], feed_by: str = "file") -> DataFrame:
    """Entries of Atom files, in the same shape."""
    return _reader(spark, "entry", _ENTRY).load(path).select(
        _feed(feed_by),
        F.col("id").alias("entry_id"),
        _page_link(F.col("link")).alias("url"),
        "title",
        F.coalesce("published", "updated").alias("date"),
        F.coalesce("content", "summary").alias("text"),
    )


def article_texts(entries: DataFrame, pages: DataFrame | None = None, page_url_col: str = "url") -> DataFrame:
    """Entries with the plain text of the article in ``text``: that of the stored page
    behind the link, else that of the entry's own markup.

    Links and URLs are compared without scheme, fragment and closing slash; the host
    in any case.  Of pages with one URL the longest article counts.
    """
    own = entries.withColumn("text", web.article_text(F.col("text")))
    if pages is None:
        return own

    def place(url):
        host, rest = urls.split_bare(urls.without_scheme(F.regexp_replace(url, "#.*$", "")))
        return F.regexp_replace(F.concat(host, rest), "/$", "")

    linked = own.withColumn("_place", place(F.col("url")))
    # only pages behind a link are read for their text
    wanted = pages.select(place(F.col(page_url_col)).alias("_place"), "html").join(
        checked(linked.select("_place").where("_place IS NOT NULL").distinct()), "_place", "left_semi"
    )
    text = web.article_text(F.col("html"))
    read = wanted.select("_place", text.alias("_article")).where("_article <> ''")
    best = read.groupBy("_place").agg(F.max_by("_article", F.struct(F.length("_article"), "_article")).alias("_article"))
    joined = linked.join(best, "_place", "left")
    return joined.withColumn("text", F.coalesce("_article", "text")).drop("_place", "_article")


def feed_articles(
    entries: DataFrame, max_articles: int = 1000, min_chars: int = 200, max_chars: int = 1000,
    pages: DataFrame | None = None,
) -> DataFrame:
    """First entries of each feed, then those of longer articles, cut to an excerpt.

    The cap comes before the length filter.  The newest entries come first, as
    they stand in a feed; entries of one moment follow their id (a number before
    a text), and entries without a readable date come last.  The article is that of
    ``article_texts``: of the stored ``pages`` where one is behind the link.
    """
    newest = -F.unix_micros(entry_time(F.col("date")))
    number = F.expr("try_cast(entry_id as bigint)")
    order = F.struct(
        newest.isNull().alias("undated"), newest.alias("newest"), number.isNull().alias("text"),
        number.alias("number"), "entry_id", "url",
    )
    capped = windows.first_n(entries.withColumn("_order", order), "feed", max_articles, "_order")
    found = article_texts(capped.drop("_order"), pages)
    return filters.longer_than(found, min_chars).withColumn("text", tx.excerpt(F.col("text"), max_chars))
