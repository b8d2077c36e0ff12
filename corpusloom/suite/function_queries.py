"""F01-F15, N01-N04 and L01-L04."""

from pyspark.sql import functions as F

from corpusloom.functions import entities as ent, keys, lexical, scores, text as tx, urls
from corpusloom.plans import prepare
from corpusloom.suite import sqlparts as S
from corpusloom.suite.aggregate_queries import rounded
from corpusloom.suite.registry import NEWS, query


@query(
    "f01_strip_dateline",
    rf"""WITH {NEWS} SELECT row_id,
    regexp_replace(text, '^.*\(Reuters\){S.SP}*-{S.SP}*', '') AS text FROM news""",
)
def _(t):
    return t.news.select("row_id", tx.strip_dateline(F.col("text")).alias("text"))


@query("f02_excerpt", "SELECT doc_id, left(text, 1000) AS text FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.excerpt(F.col("text")).alias("text"))


@query(
    "f03_first_words",
    f"""SELECT doc_id, array_to_string(({S.word_list('text')})[1:500], ' ') AS text
    FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", tx.first_words(F.col("text")).alias("text"))


@query(
    "f04_lengths",
    f"""SELECT doc_id, CAST(length(text) AS INTEGER) AS chars_length,
    {S.n_words('text')} AS words_length,
    CAST(len(regexp_extract_all(text, '{S.TOK}')) AS INTEGER) AS tokens_length FROM documents""",
    heavy=True,
)
def _(t):
    df = t.documents.select("doc_id", "text")
    for method in tx.LENGTH_METHODS:
        df, _name = tx.add_length_column(df, "text", method)
    return df.drop("text")


@query(
    "f05_clean_plain",
    f"""SELECT doc_id, regexp_replace(regexp_replace(lower(text), '^{S.SP}+|{S.SP}+$', '', 'g'),
    '{S.SP}+', ' ', 'g') AS text FROM documents""",
    heavy=True,
)
def _(t):
    return t.documents.select("doc_id", tx.clean_text(F.col("text"), repair=False).alias("text"))


@query("f06_repair", f"SELECT doc_id, {S.repaired('text')} AS text FROM documents", heavy=True)
def _(t):
    return t.documents.select("doc_id", tx.clean_text(F.col("text")).alias("text"))


@query(
    "f06_repair_markup",
    f"""WITH h AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS text FROM pages)
    SELECT page_id, {S.repaired('text')} AS text FROM h""",
    heavy=True,
)
def _(t):
    bare = F.regexp_replace("html", "<[^>]*>", " ")
    return t.pages.select("page_id", tx.repair_text(bare).alias("text"))


# Letters that are written as references, and the sign each of them stands for.
_WRITTEN = {"q": ("&#8217;", 8217), "x": ("&times;", 215), "z": ("&#x2019;", 8217), "j": ("&euro;", 8364),
            "k": ("&ntilde;", 241), "w": ("&notin;", 8713), "v": ("&amp;amp;eacute;", 233), "y": ("&#0128512;", 128512)}


def _signs() -> str:
    out = "translate(text, '<&', '(+')"
    for letter, (_, number) in _WRITTEN.items():
        out = f"replace({out}, '{letter}', chr({number}))"
    return out


@query(
    "f06_references",
    f"""WITH w AS (SELECT doc_id, {_signs()} AS text FROM documents)
    SELECT doc_id, {S.repaired('text')} AS text FROM w""",
    heavy=True,
)
def _(t):
    # by way of private signs, as references have letters themselves
    private = {letter: chr(0xE000 + i) for i, letter in enumerate(_WRITTEN)}
    written = F.translate("text", "<&" + "".join(private), "(+" + "".join(private.values()))
    for letter, (reference, _) in _WRITTEN.items():
        written = F.replace(written, F.lit(private[letter]), F.lit(reference))
    return t.documents.select("doc_id", tx.repair_text(written).alias("text"))


@query(
    "f07_mask_entities",
    f"""SELECT doc_id, {S.masked('text', 'text')} AS text FROM documents""",
    heavy=True,
)
def _(t):
    tagged = ent.tag_entities(F.col("text"), S.GAZETTEER)
    return t.documents.select("doc_id", ent.mask_entities(F.col("text"), tagged).alias("text"))


@query("f08_text_seed", f"SELECT doc_id, {S.seed('text')} AS seed FROM documents")
def _(t):
    return t.documents.select("doc_id", keys.text_seed(F.col("text")).alias("seed"))


def _shown(text: str) -> str:
    return (
        f"array_to_string(list_transform({S.entity_list(text)}, "
        f"lambda e: e.word || ' (' || e.g || ')'), ', ')"
    )


@query(
    "f09_merge_entities",
    f"""SELECT doc_id, CASE WHEN lang = 'en' THEN text || ' [SEP] ' || {_shown('text')}
       ELSE {_shown('text')} || ' [SEP] ' || text END AS text FROM documents""",
    heavy=True,
)
def _(t):
    tagged = t.documents.withColumn("entities", ent.tag_entities(F.col("text"), S.GAZETTEER))
    after = tx.merge_entities(F.col("text"), F.col("entities"), "append")
    before = tx.merge_entities(F.col("text"), F.col("entities"), "prepend")
    return tagged.select(
        "doc_id", F.when(F.col("lang") == "en", after).otherwise(before).alias("text")
    )


@query(
    "f10_normalise_host",
    "SELECT page_id, rtrim_one AS host FROM (SELECT page_id, CASE WHEN bare LIKE '%/' "
    "THEN substr(bare, 1, length(bare) - 1) ELSE bare END AS rtrim_one FROM (SELECT page_id, "
    "CASE WHEN lower(url) LIKE 'https://%' THEN substr(lower(url), 9) "
    "WHEN lower(url) LIKE 'http://%' THEN substr(lower(url), 8) ELSE lower(url) END AS bare FROM pages))",
)
def _(t):
    return t.pages.select("page_id", urls.normalise_host(F.col("url")).alias("host"))


@query("f11_url_host", f"SELECT page_id, {S.host('url')} AS host FROM pages")
def _(t):
    return t.pages.select("page_id", urls.url_host(F.col("url")).alias("host"))


@query("f12_origin_tag", f"SELECT page_id, 'cc:' || {S.host('url')} AS tag FROM pages")
def _(t):
    return t.pages.select("page_id", urls.origin_tag(urls.url_host(F.col("url"))).alias("tag"))


@query(
    "f13_composite_key",
    """SELECT d.doc_id, d.lang || '__' || coalesce(CAST(l.quality AS VARCHAR), 'nan') || '__'
    || coalesce(CAST(l.toxic AS VARCHAR), 'nan') AS key
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return joined.select("doc_id", keys.composite_key("lang", "quality", "toxic").alias("key"))


VOCABULARY = f"""lists AS (SELECT doc_id, regexp_extract_all(lower(text), '{S.TOK}') AS ts FROM documents),
    vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY count(*) DESC, token) + 1 AS INTEGER)
      AS id FROM (SELECT unnest(ts) AS token FROM lists) GROUP BY token
      ORDER BY count(*) DESC, token LIMIT 30000)"""


@query(
    "f14_token_ids",
    f"""WITH {VOCABULARY},
    cut AS (SELECT doc_id, unnest(ts[1:64]) AS token, generate_subscripts(ts[1:64], 1) AS pos
            FROM lists),
    ids AS (SELECT doc_id, list(coalesce(v.id, 1) ORDER BY pos) AS ids
            FROM cut c LEFT JOIN vocab v ON c.token = v.token GROUP BY doc_id)
    SELECT l.doc_id,
      array_to_string(list_resize(coalesce(ids, []), 64, 0), ' ') AS input_ids,
      CAST(least(len(ts), 64) AS INTEGER) AS n_real
    FROM lists l LEFT JOIN ids i ON l.doc_id = i.doc_id""",
    heavy=True,
)
def _(t):
    docs = t.documents.select("doc_id", "text")
    encoded = prepare.encode(docs, prepare.token_vocabulary(docs), id_col="doc_id")
    return encoded.select(
        "doc_id",
        F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real"),
    )


@query(
    "f15_round_and_cast",
    """SELECT doc_id, round(n_chars / 7.0, 2) AS share, CAST(n_chars AS INTEGER) AS support
    FROM documents""",
)
def _(t):
    return t.documents.select(
        "doc_id",
        F.round(F.col("n_chars") / F.lit(7.0), 2).alias("share"),
        F.col("n_chars").cast("int").alias("support"),
    )


@query(
    "n01_entities",
    f"SELECT doc_id, {_shown('text')} AS entities FROM documents",
    heavy=True,
)
def _(t):
    docs = t.documents.withColumnRenamed("doc_id", "row_id")
    tagged = ent.extract_entities(docs, S.GAZETTEER)
    return tagged.select(
        F.col("row_id").alias("doc_id"), tx.render_entities(F.col("entities")).alias("entities")
    )


@query(
    "n02_explode_entities",
    f"""WITH e AS (SELECT doc_id, {S.entity_list('text')} AS es FROM documents),
    x AS (SELECT doc_id, unnest(CASE WHEN len(es) = 0 THEN [NULL] ELSE es END) AS s FROM e)
    SELECT doc_id, s.word AS entity, s.g AS entity_group FROM x""",
    heavy=True,
)
def _(t):
    tagged = t.documents.select(
        "doc_id", ent.tag_entities(F.col("text"), S.GAZETTEER).alias("entities")
    )
    return ent.explode_entities(tagged)


@query(
    "n03_masking_order",
    f"""WITH e AS (SELECT doc_id, regexp_extract_all(text, '{S.CAND}', 1) AS es FROM documents),
    x AS (SELECT doc_id, unnest(es) AS w, generate_subscripts(es, 1) AS i FROM e),
    d AS (SELECT doc_id, w, min(i) AS i FROM x GROUP BY doc_id, w),
    o AS (SELECT doc_id, string_agg(w, '|' ORDER BY length(w) DESC, i) AS words FROM d GROUP BY doc_id)
    SELECT e.doc_id, coalesce(words, '') AS words FROM e LEFT JOIN o ON e.doc_id = o.doc_id""",
    heavy=True,
)
def _(t):
    tagged = ent.tag_entities(F.col("text"), S.GAZETTEER)
    return t.documents.select(
        "doc_id", F.array_join(ent.masking_order(tagged), "|").alias("words")
    )


@query(
    "m01_extract_entities_by_table",
    f"""WITH g AS (SELECT DISTINCT word FROM
        (SELECT unnest(regexp_extract_all(text, '{S.CAND}', 1)) AS word FROM benchmark)),
    e AS (SELECT doc_id, regexp_extract_all(text, '{S.CAND}', 1) AS es FROM documents),
    x AS (SELECT doc_id, unnest(es) AS w FROM e)
    SELECT doc_id, count(*) AS n_entities, count(*) FILTER (g.word IS NOT NULL) AS n_org
    FROM x LEFT JOIN g ON x.w = g.word GROUP BY doc_id""",
)
def _(t):
    gazetteer = (
        t.benchmark.select(F.explode(ent.candidates(F.col("text"))).alias("word"))
        .distinct()
        .withColumn("entity_group", F.lit("ORG"))
    )
    docs = t.documents.select(F.col("doc_id").alias("row_id"), "text")
    tagged = ent.extract_entities(docs, gazetteer)
    hits = F.filter("entities", lambda e: e["entity_group"] == "ORG")
    return tagged.filter(F.size("entities") > 0).select(
        F.col("row_id").alias("doc_id"),
        F.size("entities").cast("long").alias("n_entities"),
        F.size(hits).cast("long").alias("n_org"),
    )


@query(
    "n04_score_shapes",
    """SELECT doc_id, CASE WHEN n_chars > 800 THEN '1' ELSE '0' END AS label,
    CAST(n_chars AS DOUBLE) AS score FROM documents""",
)
def _(t):
    one = F.struct(
        F.when(F.col("n_chars") > 800, "1").otherwise("0").alias("label"),
        F.col("n_chars").cast("double").alias("score"),
    )
    shaped = scores.normalise_scores(t.documents.withColumn("prediction", one))
    best = shaped.withColumn("best", scores.best_score(F.col("prediction")))
    return best.select("doc_id", "best.label", "best.score")


@query(
    "l01_terms_ttr",
    f"""WITH {S.hdd_ctes('documents', 'doc_id')}
    SELECT d.doc_id, CAST(coalesce(terms, 0) AS INTEGER) AS terms,
           round(CAST(terms AS DOUBLE) / words, 6) AS ttr
    FROM documents d LEFT JOIN hdd h ON d.doc_id = h.row_id""",
    heavy=True,
)
def _(t):
    rich = lexical.add_richness(t.documents.select("doc_id", "text"), "text", ("terms", "ttr"))
    return rounded(rich.drop("text"))


@query(
    "l02_mtld",
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents),
    p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM t),
    k AS (SELECT doc_id, i, n, coalesce(lag(i) OVER o, 0) AS prev,
            coalesce(n + 1 - lead(i) OVER o, 0) AS nxt
          FROM p WINDOW o AS (PARTITION BY doc_id, w ORDER BY i)),
    s AS (SELECT doc_id, any_value(n) AS n, list(prev ORDER BY i) AS fw,
            list(nxt ORDER BY i DESC) AS bw FROM k GROUP BY doc_id),
    walk AS (SELECT doc_id, n,
      list_reduce(fw, lambda a, x: CASE WHEN
          (a.types + CAST(x < a.begin AS INTEGER)) / (a.at - a.begin + 1) <= 0.72
        THEN {'f': a.f + 1, 'begin': a.at + 1, 'types': 0, 'at': a.at + 1}
        ELSE {'f': a.f, 'begin': a.begin, 'types': a.types + CAST(x < a.begin AS INTEGER),
              'at': a.at + 1} END,
        {'f': 0, 'begin': 1, 'types': 0, 'at': 1}) AS a,
      list_reduce(bw, lambda a, x: CASE WHEN
          (a.types + CAST(x < a.begin AS INTEGER)) / (a.at - a.begin + 1) <= 0.72
        THEN {'f': a.f + 1, 'begin': a.at + 1, 'types': 0, 'at': a.at + 1}
        ELSE {'f': a.f, 'begin': a.begin, 'types': a.types + CAST(x < a.begin AS INTEGER),
              'at': a.at + 1} END,
        {'f': 0, 'begin': 1, 'types': 0, 'at': 1}) AS b FROM s),
    fac AS (SELECT doc_id, n,
      a.f + CASE WHEN a.begin <= n THEN (1 - a.types / (n - a.begin + 1)) / (1 - CAST(0.72 AS DOUBLE)) ELSE 0 END AS fa,
      b.f + CASE WHEN b.begin <= n THEN (1 - b.types / (n - b.begin + 1)) / (1 - CAST(0.72 AS DOUBLE)) ELSE 0 END AS fb
      FROM walk)
    SELECT d.doc_id, round((n / CASE WHEN fa = 0 THEN 1 ELSE fa END
      + n / CASE WHEN fb = 0 THEN 1 ELSE fb END) / 2, 4) AS mtld
    FROM documents d LEFT JOIN fac f ON d.doc_id = f.doc_id""",
    heavy=True,
)
def _(t):
    rich = lexical.add_richness(t.documents.select("doc_id", "text"), "text", ("mtld",))
    return rounded(rich.drop("text"), 4)


@query(
    "l03_hdd",
    f"""WITH {S.hdd_ctes('documents', 'doc_id')}
    SELECT d.doc_id, round(h.hdd, 6) AS hdd
    FROM documents d LEFT JOIN hdd h ON d.doc_id = h.row_id""",
    heavy=True,
)
def _(t):
    rich = lexical.add_richness(t.documents.select("doc_id", "text"), "text", ("hdd",))
    return rounded(rich.drop("text"))


@query(
    "l04_empty_rows",
    f"""WITH v AS (SELECT page_id AS row_id, url,
        regexp_replace(html, '[\\p{{L}}]', '', 'g') AS bare FROM pages),
    u AS (SELECT row_id, CASE WHEN contains(url, '/en/') THEN url ELSE bare END AS text FROM v),
    {S.hdd_ctes('u')}
    SELECT u.row_id, CAST(coalesce(terms, 0) AS INTEGER) AS terms, round(h.hdd, 6) AS hdd,
      round(CAST(terms AS DOUBLE) / words, 6) AS ttr FROM u LEFT JOIN hdd h ON u.row_id = h.row_id""",
    heavy=True,
)
def _(t):
    emptied = t.pages.select(
        F.col("page_id").alias("row_id"),
        F.when(F.contains("url", F.lit("/en/")), F.col("url"))
        .otherwise(F.regexp_replace("html", r"[\p{L}]", ""))
        .alias("text"),
    )
    return rounded(lexical.add_richness(emptied, "text", ("terms", "hdd", "ttr")).drop("text"))
