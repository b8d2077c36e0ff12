"""Web pages on storage: index search and article text (survey S05, S06, P13, W02)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.bounded import join_checked
from corpusloom.functions import references, text as tx, urls
from corpusloom.operators import windows

# ---- fixed values -------------------------------------------------------
NOISE_TAGS = ["script", "style", "nav", "footer", "aside", "form", "noscript"]
NOISE = "(?is)" + "|".join(
    ["<!--.*?-->"] + [rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in NOISE_TAGS]
)
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
ARTICLE = r"(?is)<article\b[^>]*>(.*)</article>"
BODY = r"(?is)<body\b[^>]*>(.*)</body>"
BREAKING_TAG = r"(?i)<(?:br|/p|/h[1-6]|/li|/div|p)\b[^>]*>"
ANY_TAG = r"<[^>]*>"
# ---- end of fixed values ------------------------------------------------


def _plain(markup: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(markup, BREAKING_TAG, " "), ANY_TAG, "")
    return F.array_join(tx.words(references.decode(bare, open_ended=True)), " ")


def page_title(html: Column) -> Column:
    """The title element, tags and entities resolved; null when there is none."""
    title = F.regexp_extract(html, TITLE, 1)
    return F.when(title != "", _plain(title))


def article_text(html: Column) -> Column:
    """Text of the article element, else of the body, without page furniture."""

    def pick(clean: Column) -> Column:
        inside = F.regexp_extract(clean, ARTICLE, 1)
        body = F.regexp_extract(clean, BODY, 1)
        return _plain(F.when(inside != "", inside).when(body != "", body).otherwise(clean))

    return tx.let(F.regexp_replace(html, NOISE, " "), pick)


def extract_articles(
    pages: DataFrame, max_words: int = 500, html_col: str = "html", url_col: str = "url"
) -> DataFrame:
    """Url, title and the first words of every page that has text."""
    others = [c for c in pages.columns if c not in (html_col, url_col)]
    title = page_title(F.col(html_col))
    found = tx.let(
        article_text(F.col(html_col)),
        lambda t: F.when(
            t != "",
            F.array(F.struct(title.alias("title"), tx.first_words(t, max_words).alias("text"))),
        ),
    )
    # a generator evaluates the extraction once; a filter on the text would be
    # moved below it and extract every page twice
    return pages.select(*others, url_col, F.inline(found))


def match_index(
    pages: DataFrame,
    entries: Iterable[Mapping[str, object]] | DataFrame,
    limit: int | None = 50,
    url_col: str = "url",
    id_col: str = "page_id",
    crawl_col: str | None = None,
) -> DataFrame:
    """Pages that match ``domain/pattern`` entries, first ``limit`` each.

    All entries are tried in one pass; a page that fits several entries gives
    a row for each, told apart by ``entry_no`` for a list.  ``entries`` is a list of
    mappings with ``domain``, ``pattern`` and optionally ``label`` and ``index``, or a
    table of such columns for lists too long for a query text.  A star in the domain
    stays within the host.  With ``crawl_col`` an entry takes only pages of the crawl
    that its ``index`` names, and pages of all crawls if it names none.
    """
    found = pages.filter(F.coalesce(F.col(url_col), F.lit("")) != "")
    host, rest = urls.split_bare(urls.without_scheme(F.col(url_col)))
    named = found.withColumn("_host", host).withColumn("_rest", rest)
    if isinstance(entries, DataFrame):
        found = _matches_of_table(named, entries, crawl_col)
    else:
        found = _matches_of_list(named, [dict(e) for e in entries], crawl_col)
    found = found.drop("_host", "_rest")
    if limit is None:
        return found
    of_entry = ["entry_no"] if "entry_no" in found.columns else ["domain", "pattern"]
    return windows.first_n(found, of_entry, limit, id_col)


def _matches_of_list(named: DataFrame, listed: list[dict], crawl_col: str | None) -> DataFrame:
    """Entries as conditions of the query."""
    tries = []
    for no, e in enumerate(listed):
        domain, pattern = str(e["domain"]).strip(), str(e.get("pattern", "*"))
        host_like, rest_like = urls.wildcard_parts(domain, pattern)
        fits = F.col("_host").like(host_like) & F.col("_rest").like(rest_like)
        if crawl_col and e.get("index") is not None:
            fits &= F.col(crawl_col) == F.lit(str(e["index"]))
        entry = F.struct(
            F.lit(no).alias("entry_no"), F.lit(domain).alias("domain"), F.lit(pattern).alias("pattern"),
            F.lit(e.get("label")).cast("int").alias("label"),
        )
        tries.append(F.when(fits, entry))
    hosts = {str(e["domain"]).strip().lower().split("/")[0] for e in listed}
    # one hash look-up spares most pages the patterns
    some = F.lit(True) if any("*" in h for h in hosts) else F.col("_host").isin(sorted(hosts))
    tried = named.filter(some).withColumn("_entry", F.explode(F.array_compact(F.array(*tries))))
    return tried.select("*", "_entry.*").drop("_entry")


def _matches_of_table(named: DataFrame, entries: DataFrame, crawl_col: str | None) -> DataFrame:
    """Entries as a table, joined by the host.

    Which hosts a star takes is found on the different hosts alone: each meets the
    entries that end in the same labels, and the pattern decides among these.
    """
    host_like, rest_like = urls.wildcard_columns(F.col("domain"), F.col("pattern"))
    table = entries.withColumn("_host_like", host_like).withColumn("_rest_like", rest_like)
    starred = F.contains(F.split_part("domain", F.lit("/"), F.lit(1)), F.lit("*"))
    own = F.split_part(F.lower(F.trim("domain")), F.lit("/"), F.lit(1)).alias("_host")
    exact = table.where(~starred).select("*", own)
    wild = table.where(starred).withColumn("_suffix", urls.literal_suffix(F.col("domain")))
    if wild.isEmpty():
        by_host = exact
    else:
        hosts = named.select("_host").distinct()
        ends = hosts.select("_host", F.explode(urls.host_suffixes(F.col("_host"))).alias("_suffix"))
        taken = join_checked(ends, wild, "_suffix").where(F.expr("_host like _host_like"))
        by_host = exact.unionByName(taken.select(*exact.columns))
    found = join_checked(named, by_host.drop("_host_like"), "_host")
    found = found.where((F.col("_rest_like") == "/%") & F.startswith("_rest", F.lit("/")) | F.expr("_rest like _rest_like"))
    if crawl_col and "index" in entries.columns:
        found = found.where(F.col("index").isNull() | (F.col("index") == F.col(crawl_col)))
    return found.drop("_rest_like", "index")
