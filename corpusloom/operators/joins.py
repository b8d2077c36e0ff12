"""Joins (survey J01-J08)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.bounded import join_checked
from corpusloom.functions import urls
from corpusloom.session import materialise

_WORD = r"[\p{L}\p{N}_]"
# Keys of aliases that are broadcast at most; a key takes 16 bytes, about 50 in the hash table.
MAX_ALIAS_KEYS = 2_000_000


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in ``keys``."""
    return join_checked(df, keys, on, "left_semi")


def drop_rows(df: DataFrame, bad: DataFrame, on: str = "row_id") -> DataFrame:
    """Rows whose identity is not in ``bad``; both sides may be large."""
    return df.join(bad, on, "left_anti")


def lookup(df: DataFrame, table: DataFrame, on: str) -> DataFrame:
    """Add the columns of a per-key table; unmatched rows get nulls."""
    return join_checked(df, table, on, "left")


def align_counts(left: DataFrame, right: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """Two count lists side by side, 0 where one side has no entry."""
    out = left.join(right, on, "full")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in columns})


def attach_by_row(df: DataFrame, results: DataFrame, on: str = "row_id") -> DataFrame:
    """Per-row results joined back to their rows."""
    return df.join(results, on, "left")


def whole_word_pattern(aliases: Iterable[str]) -> str | None:
    """One pattern that finds any alias as a whole word in lower-cased text.

    The boundary is between a word and a non-word sign, also for aliases that
    begin or end with punctuation.
    """
    alternatives = []
    for alias in sorted({a.lower() for a in aliases if a}):
        before = f"(?<!{_WORD})" if re.match(r"\w", alias[0]) else f"(?<={_WORD})"
        after = f"(?!{_WORD})" if re.match(r"\w", alias[-1]) else f"(?={_WORD})"
        alternatives.append(before + r"\Q" + alias.replace(r"\E", r"\E\\E\Q") + r"\E" + after)
    return "|".join(alternatives) or None


def mentions_own_alias(
    text: Column, label: Column, aliases: Mapping[object, Iterable[str]]
) -> Column:
    """An alias of the row's own label occurs in the text.

    The alias map is a driver literal, so each label's aliases become one
    compiled pattern and the text is looked at once, without a join.
    """
    hit = F.lit(False)
    lowered = F.lower(text)
    for value, names in aliases.items():
        pattern = whole_word_pattern(names)
        if pattern is not None:
            hit = F.when(label == F.lit(value), lowered.rlike(pattern)).otherwise(hit)
    return F.coalesce(hit, F.lit(False))


def _pieces(text: Column) -> Column:
    """Words and what stands between them, in turn, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{_WORD}+|[^{_WORD[1:]}+"), F.lit(0))


def own_alias_hits(
    df: DataFrame,
    aliases: DataFrame,
    text_col: str = "text",
    label_col: str = "is_bs",
    row_col: str = "row_id",
    alias_label_col: str = "label",
    alias_col: str = "alias",
    max_keys: int = MAX_ALIAS_KEYS,
) -> DataFrame:
    """J06 with a table of aliases: per row the leftmost, then longest alias of its own label.

    Finds what ``mentions_own_alias`` finds (whose pattern does not see letters beyond U+FFFF
    in front of an alias, while these are letters here). As a boundary is between a word and another
    sign, an alias occurs where its pieces (words, and what stands between them) equal
    pieces of the text, end to end; so aliases and stretches of as many pieces meet by
    equal hashes of 128 bits, and texts are not moved. Keys are 16 bytes wide: up to
    ``max_keys`` of them are broadcast, more are joined by shuffle.

    Rows without an alias, with a null text or label, and null or empty aliases give
    nothing; repeated aliases count once. ``place`` is the first piece, from 1 at the
    first word of the text; ``alias`` is in lower case. A long text costs 40 bytes a
    piece and different alias length while its row is worked on.
    """
    kind = df.schema[label_col].dataType

    def keys(label: Column, pieces: Column) -> list[Column]:
        return [F.xxhash64(label, pieces).alias("h1"), F.xxhash64(F.lit(1), label, pieces).alias("h2")]

    named = aliases.select(
        F.col(alias_label_col).cast(kind).alias("label"), F.lower(alias_col).alias("alias")
    ).filter(F.col("label").isNotNull() & (F.col("alias") != ""))
    pieces = _pieces(F.col("alias"))
    named = materialise(
        named.distinct().select("alias", F.size(pieces).alias("n"), *keys(F.col("label"), pieces)), "aliases"
    )
    lengths = sorted(r["n"] for r in named.select("n").distinct().collect()) or [1]

    every = df.filter(F.col(label_col).isNotNull()).select(
        F.col(row_col).alias("row"), F.col(label_col).alias("own"), _pieces(F.col(text_col)).alias("e")
    )
    wordless = rf"^[^{_WORD[1:]}"
    before = F.get("e", F.lit(0)).rlike(wordless).cast("int")
    behind = F.get("e", F.size("e") - 1).rlike(wordless).cast("int")
    # what stands before the first and behind the last word is next to one word only
    inner = F.when(F.size("e") > 1, F.slice("e", before + 1, F.size("e") - before - behind)).otherwise(
        F.filter("e", lambda p: ~p.rlike(wordless))
    )
    texts = every.select("row", "own", inner.alias("p"))

    def stretches(n: int) -> Column:
        last = F.size("p") - n + 1
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(
            places,
            lambda i: F.struct(i.alias("place"), F.lit(n).alias("n"), *keys(F.col("own"), F.slice("p", i, n))),
        )

    # an outer generator: for an inner one Spark would make the arrays twice, to filter by their size
    rows = texts.select("row", "own", F.explode_outer(F.concat(*[stretches(n) for n in lengths])).alias("s"))
    wanted = named.select("h1", "h2")
    if named.count() <= max_keys:
        wanted = F.broadcast(wanted)
    hits = rows.select("row", "own", "s.*").join(wanted, ["h1", "h2"], "left_semi")
    first = hits.groupBy("row", "own").agg(F.min(F.struct("place", -F.col("n"), "h1", "h2")).alias("s"))
    found = first.select("row", "own", "s.place", "s.h1", "s.h2").join(named.select("h1", "h2", "alias"), ["h1", "h2"])
    return found.select(F.col("row").alias(row_col), F.col("own").alias(label_col), "place", "alias")


def label_by_host(
    df: DataFrame,
    bs_hosts: Iterable[str],
    legit_hosts: Iterable[str],
    url_col: str = "url",
    label_col: str = "is_bs",
) -> DataFrame:
    """1 for hosts of the first list, 0 for the second, else null.

    Works on batch and streaming frames alike.
    """
    host = urls.url_host(F.col(url_col))
    return df.withColumn(
        label_col,
        F.when(host.isin(urls.normalise_hosts(bs_hosts)), F.lit(1))
        .when(host.isin(urls.normalise_hosts(legit_hosts)), F.lit(0))
        .otherwise(F.lit(None).cast("int")),
    )


def compare_label_sets(train: DataFrame, test: DataFrame, label_col: str = "labels") -> DataFrame:
    """Rows per label in both splits, and whether a label is missing in one."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias(name))

    both = align_counts(
        counts(train, "n_train"), counts(test, "n_test"), "label", ["n_train", "n_test"]
    )
    return both.withColumn("mismatch", (F.col("n_train") == 0) | (F.col("n_test") == 0))
