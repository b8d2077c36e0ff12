"""License detection by ordered signature rules, in DataFrame expressions only.

Texts are brought to one line of lower-case words.  A keyword gate decides
which rules a text is tried on; a rule is a regular expression over that line
with a label, a priority and a confidence.  Detections are word intervals; one
that lies inside an interval of a rule of the same or a higher priority is
suppressed, so "gnu lesser general public license" does not also speak for the
general one.

Rules are written as families: the names a license goes by, the versions it
has, and the sentences in which licenses are granted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOT_WORD = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
WORD = f"[^{NOT_WORD}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Families: label, keyword, name patterns, version patterns that may follow.
FAMILIES = [
    ("gpl", "gpl", ["gpl", "gnu gpl"], ["v?1", "v?2", "v?3", "2 0", "3 0"]),
    ("gpl", "gnu", ["gnu general public licen[sc]e", "gnu public licen[sc]e"], ["version [123]", "v[123]", "[123] 0"]),
    ("lgpl", "lgpl", ["lgpl", "gnu lgpl"], ["v?2", "v?3", "2 1", "3 0"]),
    ("lgpl", "lesser", ["(?:gnu )?lesser general public licen[sc]e"], ["version [23]", "v[23]", "2 1", "3 0"]),
    ("lgpl", "library", ["gnu library general public licen[sc]e"], ["version 2", "2 0"]),
    ("agpl", "agpl", ["agpl", "gnu agpl"], ["v?3", "3 0", "1 0"]),
    ("agpl", "affero", ["(?:gnu )?affero general public licen[sc]e"], ["version 3", "v3", "3 0"]),
    ("gfdl", "documentation", ["gnu free documentation licen[sc]e"], ["version 1", "1 [123]"]),
    ("apache", "apache", ["apache licen[sc]e", "apache software licen[sc]e"], ["version [12]", "v2", "2 0", "1 [01]"]),
    ("apache", "apache", ["apache 2 0"], []),
    ("mit", "mit", ["mit licen[sc]e", "mit x11 licen[sc]e", "mit style licen[sc]e"], []),
    ("x11", "x11", ["x11 licen[sc]e"], []),
    ("bsd", "bsd", ["bsd licen[sc]e", "bsd style licen[sc]e", "new bsd licen[sc]e", "simplified bsd licen[sc]e", "modified bsd licen[sc]e"], []),
    ("bsd", "bsd", ["(?:2|two) clause bsd", "(?:3|three) clause bsd", "(?:4|four) clause bsd", "bsd [0234] clause"], ["licen[sc]e"]),
    ("isc", "isc", ["isc licen[sc]e"], []),
    ("mpl", "mozilla", ["mozilla public licen[sc]e"], ["version [12]", "v[12]", "[12] [01]"]),
    ("mpl", "mpl", ["mpl"], ["1 [01]", "2 0"]),
    ("epl", "eclipse", ["eclipse public licen[sc]e"], ["version [12]", "v[12]", "[12] 0"]),
    ("cddl", "cddl", ["cddl"], ["1 [01]"]),
    ("cddl", "distribution", ["common development and distribution licen[sc]e"], ["version 1", "1 [01]"]),
    ("cpl", "common", ["common public licen[sc]e"], ["version 1", "1 0"]),
    ("artistic", "artistic", ["artistic licen[sc]e", "perl artistic licen[sc]e"], ["version [12]", "[12] 0"]),
    ("boost", "boost", ["boost software licen[sc]e"], ["version 1", "1 0"]),
    ("zlib", "zlib", ["zlib licen[sc]e", "zlib libpng licen[sc]e"], []),
    ("unlicense", "unlicense", ["the unlicense"], []),
    ("wtfpl", "wtfpl", ["wtfpl"], ["version 2", "2 0"]),
    ("eupl", "european", ["european union public licen[sc]e"], ["version 1", "v1", "1 [12]"]),
    ("osl", "open", ["open software licen[sc]e"], ["version [123]", "[123] [01]"]),
    ("afl", "academic", ["academic free licen[sc]e"], ["version [123]", "[123] [01]"]),
    ("python", "python", ["python software foundation licen[sc]e", "psf licen[sc]e"], ["version 2", "2 0"]),
    ("ofl", "font", ["sil open font licen[sc]e", "open font licen[sc]e"], ["version 1", "1 [01]"]),
    ("odbl", "database", ["open database licen[sc]e"], ["version 1", "1 0"]),
    ("cc0", "cc0", ["cc0"], ["1 0"]),
    ("cc0", "cc", ["cc zero"], ["1 0"]),
    ("cc-by", "cc", ["cc by"], ["[1234] 0", "[1234] 5"]),
    ("cc-by-sa", "cc", ["cc by sa"], ["[1234] 0", "2 5"]),
    ("cc-by-nc", "cc", ["cc by nc"], ["[1234] 0", "2 5"]),
    ("cc-by-nd", "cc", ["cc by nd"], ["[1234] 0", "2 5"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa"], ["[1234] 0", "2 5"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd"], ["[1234] 0", "2 5"]),
    ("cc-by", "creative", ["creative commons attribution"], ["licen[sc]e", "[1234] 0", "international"]),
    ("cc-by-sa", "creative", ["creative commons attribution share ?alike"], ["licen[sc]e", "[1234] 0", "international"]),
    ("cc-by-nc", "creative", ["creative commons attribution non ?commercial"], ["licen[sc]e", "[1234] 0", "international"]),
    ("cc-by-nd", "creative", ["creative commons attribution no ?deriv(?:s|atives)"], ["licen[sc]e", "[1234] 0", "international"]),
    ("cc-by-nc-sa", "creative", ["creative commons attribution non ?commercial share ?alike"], ["licen[sc]e", "[1234] 0"]),
    ("cc-by-nc-nd", "creative", ["creative commons attribution non ?commercial no ?deriv(?:s|atives)"], ["licen[sc]e", "[1234] 0"]),
    ("public-domain", "domain", ["public domain dedication", "dedicated to the public domain", "released into the public domain"], []),
    ("proprietary", "reserved", ["all rights reserved"], []),
    ("proprietary", "confidential", ["proprietary and confidential", "confidential and proprietary"], []),
]
# Sentences in which a name stands, with what they add to the confidence.
GRANTS = [
    ("", 0.7),
    ("licensed under (?:the |a )?(?:terms of (?:the )?)?", 0.95),
    ("released under (?:the |a )?(?:terms of (?:the )?)?", 0.95),
    ("(?:distributed|available|published|provided) under (?:the |a )?(?:terms of (?:the )?)?", 0.9),
    ("spdx license identifier ", 1.0),
]
# Texts of licenses themselves.
CLAUSES = [
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("isc", "granted", "permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification", 1.0),
    ("bsd", "endorse", "may (?:not )?be used to endorse or promote products derived from", 0.9),
    ("gpl", "redistribute", "redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 1.0),
    ("lgpl", "redistribute", "redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e", 1.0),
    ("agpl", "redistribute", "redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 1.0),
    ("apache", "apache", "you may not use this file except in compliance with the license.{0,80}apache", 0.9),
    ("unlicense", "unencumbered", "free and unencumbered software released into the public domain", 1.0),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented", 1.0),
    ("boost", "granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 1.0),
    ("wtfpl", "fuck", "do what the fuck you want to public licen[sc]e", 1.0),
    ("mpl", "mozilla", "subject to the terms of the mozilla public licen[sc]e", 1.0),
]
SPDX = {
    "mit": ["mit"], "isc": ["isc"], "apache": ["apache 2 0"], "zlib": ["zlib"], "boost": ["bsl 1 0"],
    "gpl": ["gpl [23] 0"], "lgpl": ["lgpl [23] [01]"], "agpl": ["agpl 3 0"], "mpl": ["mpl [12] [01]"],
    "bsd": ["bsd [234] clause"], "epl": ["epl [12] 0"], "unlicense": ["unlicense"], "cc0": ["cc0 1 0"],
}


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """``(rule, label, keyword, pattern, priority, confidence)``, in order.

    Priority: clauses 4, identifiers 3, names with a version 2, names alone 1.
    """
    found = [(label, word, text, 4, sure) for label, word, text, sure in CLAUSES]
    found += [
        (label, "spdx", f"spdx license identifier {name}(?: (?:only|or later))?", 3, 1.0)
        for label, names in SPDX.items()
        for name in names
    ]
    for label, word, names, versions in FAMILIES:
        for grant, sure in GRANTS:
            for name in names:
                if versions:
                    numbers = "|".join(versions)
                    found.append((label, word, f"{grant}{name}(?: (?:version|v|{numbers}))+", 2, sure))
                found.append((label, word, f"{grant}{name}", 1, sure - 0.1))
    return [(i, *r) for i, r in enumerate(found)]


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _word_start(line: Column, before: Column) -> Column:
    """Words in front of a place in the line: each ends with one space."""
    return F.length(before) - F.length(F.replace(before, F.lit(" "), F.lit("")))


def base_matches(rows: DataFrame) -> DataFrame:
    """``n_base, first_word, last_word, base_labels`` of ``line``: every place of a phrase."""
    line = F.col("line")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE.items():
        whole = f"(?<= ){phrase}(?= )"
        n = F.when(F.contains(line, F.lit(f" {phrase} ")), F.regexp_count(line, F.lit(whole))).otherwise(0)
        counts.append(n)
        first = F.substring_index(line, f" {phrase} ", 1)
        # what stands in front of the last one: all but the last piece and the phrase
        rest = F.length(F.substring_index(line, f" {phrase} ", -1)) + len(phrase) + 2
        last = F.substr(line, F.lit(1), F.length(line) - rest)
        held = F.contains(line, F.lit(f" {phrase} "))
        firsts.append(F.when(held, _word_start(line, first)))
        lasts.append(F.when(held, _word_start(line, last)))
        labels.append(F.when(held, F.lit(label)))
    return rows.select(
        "*",
        sum(counts, F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array_distinct(F.array(*labels)))).alias("base"),
    )


def detections(lines: DataFrame, key: str, spark: SparkSession) -> DataFrame:
    """``(key, rule, label, priority, confidence, start, stop)`` in words, before suppression.

    A text meets the rules whose keyword it holds; rules are a fixed table of
    this module, broadcast.
    """
    table = F.broadcast(
        spark.createDataFrame(
            rules(), "rule int, label string, keyword string, pattern string, priority int, confidence double"
        )
    )
    keywords = F.array(*[F.lit(w) for w in sorted({r[2] for r in rules()})])
    # a keyword stands at the beginning of a word
    present = F.filter(keywords, lambda w: F.contains(F.col("line"), F.concat(F.lit(" "), w)))
    gated = lines.select(key, "line", F.explode(present).alias("keyword"))
    tried = gated.join(table, "keyword").withColumn(
        "whole", F.concat(F.lit("(?<= )(?:"), F.col("pattern"), F.lit(")(?= )"))
    )
    tried = tried.where(F.expr("regexp_like(line, whole)"))
    pieces = F.expr("split(line, whole, -1)")
    hits = F.expr("regexp_extract_all(line, whole, 0)")
    both = tried.select(
        key, "rule", "label", "priority", "confidence",
        F.posexplode(F.arrays_zip(pieces.alias("piece"), hits.alias("hit"))).alias("k", "both"),
    )
    words_of = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    so_far = Window.partitionBy(key, "rule").orderBy("k")
    spaces = both.select(
        key, "rule", "label", "priority", "confidence", "k",
        F.col("both.hit").alias("hit"),
        words_of(F.col("both.piece")).alias("gap"),
        F.coalesce(words_of(F.col("both.hit")), F.lit(0)).alias("inside"),
    )
    placed = spaces.withColumn("end", F.sum(F.col("gap") + F.col("inside")).over(so_far))
    return placed.where("hit IS NOT NULL").select(
        key, "rule", "label", "priority", "confidence",
        (F.col("end") - F.col("inside") - 1).alias("start"),
        F.col("end").alias("stop"),
    )


def suppress(found: DataFrame, key: str) -> DataFrame:
    """Detections that no other one of the same or a higher priority contains.

    Of equal intervals the higher priority stays, of equal priorities the
    earlier rule.  One sort per text and priority, no pairs.
    """
    levels = sorted({r[4] for r in rules()}, reverse=True)
    order = Window.partitionBy(key).orderBy(
        "start", F.col("stop").desc(), F.col("priority").desc(), "rule"
    ).rowsBetween(Window.unboundedPreceding, -1)
    covered = F.lit(False)
    for level in levels:
        reach = F.max(F.when(F.col("priority") >= level, F.col("stop"))).over(order)
        covered |= (F.col("priority") == level) & (F.coalesce(reach, F.lit(-1)) >= F.col("stop"))
    return found.withColumn("covered", covered).where("NOT covered").drop("covered")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base places and labels, all labels, and a score.

    ``score`` is the confidence of the surest detection left, 0 without any; a
    label of a base phrase always stays.  Null texts are empty; rows that share
    an id, or have none, are told apart by their text.
    """
    spark = docs.sparkSession
    low = lowered(F.col(text_col))
    # most texts hold none of these and are only counted
    gate = low.rlike("licen[sc]|spdx|public|cc[^a-z]*(?:by|zero)|cc0|gpl|reserved|granted|redistribut|endorse|"
                     "misrepresented|unencumbered|confidential|creative|mpl|cddl|wtfpl|apache|bsd")
    line = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(low, F.lit(f"({WORD})"), F.lit(0)), " "), F.lit(" "))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_count(low, F.lit(WORD)).cast("long").alias("n_words"),
        F.when(gate, line).alias("line"),
    )
    marked = base_matches(rows).withColumn(
        "digest", F.when(F.col("line").isNotNull(), F.sha2("line", 256))
    )
    once = rows.where("line IS NOT NULL").select("line").distinct()
    lines = once.select(F.sha2("line", 256).alias("digest"), "line")
    left = suppress(detections(lines, "digest", spark), "digest")
    summed = left.groupBy("digest").agg(
        F.collect_set("label").alias("found"),
        F.max("confidence").alias("score"),
        F.count("*").alias("n_detections"),
    )
    # texts that were only counted have nothing to join: they are dealt out by a key of their own
    spread = F.concat(F.lit("-"), F.xxhash64("doc_id", "n_words").cast("string"))
    joined = marked.drop("line").withColumn("digest", F.coalesce("digest", spread))
    joined = joined.join(summed, "digest", "left")
    empty = F.array().cast("array<string>")
    every = F.array_sort(F.array_union("base", F.coalesce("found", empty)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.coalesce("score", F.when(F.size("base") > 0, 0.6).otherwise(0.0)).alias("score"),
        F.coalesce("n_detections", F.lit(0)).alias("n_detections"),
    )
