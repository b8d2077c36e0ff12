"""P01-P16 and J01-J08, U01-U03."""

from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.operators import aggregates, filters, joins, unions
from corpusloom.schemas import CORPUS as CORPUS_SCHEMA
from corpusloom.suite import sqlparts as S
from corpusloom.suite.registry import CORPUS, NEWS, query


@query("p01_select", "SELECT doc_id, text FROM documents")
def _(t):
    return filters.keep(t.documents, "doc_id", "text")


@query(
    "p02_tag",
    f"""SELECT page_id, CAST(1 AS INTEGER) AS is_bs, 'CC-index' AS source,
       'cc:' || {S.host('url')} AS source_detail FROM pages""",
)
def _(t):
    tagged = filters.tag(t.pages.select("page_id", "url"), is_bs=1, source="CC-index")
    return tagged.withColumn(
        "source_detail", urls.origin_tag(urls.url_host(F.col("url")))
    ).drop("url")


@query("p03_drop", "SELECT doc_id, lang, source FROM documents")
def _(t):
    return filters.drop_columns(t.documents, "text", "n_chars", "ttr", "mtld")


@query(
    "p04_copy",
    f"WITH {CORPUS} SELECT row_id, is_bs, is_bs AS labels FROM corpus",
)
def _(t):
    return filters.copy_column(t.corpus, "is_bs", "labels").select("row_id", "is_bs", "labels")


@query(
    "p05_unattributed_negatives",
    f"""WITH {NEWS} SELECT row_id, is_bs, length(text) AS chars FROM news
    WHERE NOT (is_bs = 0 AND position('(Reuters) -' IN text) = 0)""",
)
def _(t):
    return filters.drop_unattributed_negatives(t.news).select(
        "row_id", "is_bs", F.char_length("text").cast("long").alias("chars")
    )


@query("p06_contains", "SELECT page_id, url FROM pages WHERE url LIKE '%/en/%'")
def _(t):
    return filters.contains(t.pages, "url", "/en/").select("page_id", "url")


@query("p07_longer_than", "SELECT doc_id FROM documents WHERE length(text) > 200")
def _(t):
    return filters.longer_than(t.documents).select("doc_id")


@query(
    "p08_words_between",
    f"SELECT doc_id FROM documents WHERE {S.n_words('text')} BETWEEN 150 AND 1000",
    heavy=True,
)
def _(t):
    return filters.words_between(t.documents, 150, 1000).select("doc_id")


@query(
    "p09_drop_blank",
    f"""WITH v AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text
                   WHEN turn > 2 THEN ' ' || chr(9) END AS text FROM conversations)
    SELECT conv_id, turn FROM v WHERE regexp_matches(text, '{S.NSP}')""",
)
def _(t):
    holed = t.conversations.withColumn(
        "text", F.when(F.col("role") == "user", F.col("text")).when(F.col("turn") > 2, " \t")
    )
    return filters.drop_blank(holed).select("conv_id", "turn")


@query(
    "p10_label_domain",
    """SELECT label, count(*) AS n_rows FROM embeddings
    WHERE label NOT BETWEEN 0 AND 4 OR label IS NULL GROUP BY label""",
)
def _(t):
    return filters.label_violations(t.embeddings, "label", 5)


@query(
    "p10_label_names",
    f"""WITH {CORPUS} SELECT row_id, is_bs, CASE is_bs WHEN 0 THEN '0' ELSE '1' END AS label_name
    FROM corpus""",
)
def _(t):
    named = filters.enforce_labels(t.corpus, "is_bs", 2, name_col="label_name")
    return named.select("row_id", "is_bs", "label_name")


@query(
    "p11_ratio_band",
    f"""WITH {CORPUS}, s AS (SELECT topic, avg(is_bs) AS r FROM corpus GROUP BY topic)
    SELECT row_id, topic FROM corpus
    WHERE topic <> -1 AND topic IN (SELECT topic FROM s WHERE r BETWEEN 0.1 AND 0.3)""",
)
def _(t):
    topics = aggregates.topic_label_summary(t.corpus)
    kept = filters.balanced_topics(topics, 0.1, 0.3).select("topic")
    return joins.keep_keys(t.corpus, kept, "topic").select("row_id", "topic")


HOSTS = ["https://spam-farm.example.org", "WWW.cheap-pills.example.com", "blog.ththan.example.net"]
_HOST_SET = "('spam-farm.example.org', 'www.cheap-pills.example.com', 'blog.ththan.example.net')"


@query(
    "p12_host_in", f"SELECT page_id, url FROM pages WHERE {S.host('url')} IN {_HOST_SET}"
)
def _(t):
    return filters.host_in(t.pages, HOSTS).select("page_id", "url")


@query(
    "p12_host_in_table",
    f"""SELECT page_id, url FROM pages
    WHERE {S.host('url')} IN (SELECT {S.host('url')} FROM pages WHERE url LIKE '%/de/%')""",
)
def _(t):
    german = filters.contains(t.pages, "url", "/de/").select(
        urls.url_host(F.col("url")).alias("host")
    )
    return filters.host_in(t.pages, german).select("page_id", "url")


@query(
    "p13_wildcard",
    f"""SELECT page_id FROM pages WHERE {S.bare('url')} LIKE 'www.cheap-pills.example.com/en/%'
    OR {S.bare('url')} LIKE 'blog.%/%.html'""",
)
def _(t):
    url = F.col("url")
    return t.pages.filter(
        urls.matches_wildcard(url, "www.cheap-pills.example.com", "en/*")
        | urls.matches_wildcard(url, "blog.*", "*.html")
    ).select("page_id")


@query(
    "p14_categories",
    "SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'fr', 'es')",
)
def _(t):
    return filters.in_categories(t.documents, "lang", ["en", "fr", "es"]).select("doc_id", "lang")


@query(
    "p15_null_profile",
    """WITH j AS (SELECT d.doc_id, d.text, d.lang, l.quality, l.toxic
             FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT 'doc_id' AS column_name, count(*) - count(doc_id) AS n_nulls, count(*) AS n_rows FROM j
    UNION ALL SELECT 'text', count(*) - count(text), count(*) FROM j
    UNION ALL SELECT 'lang', count(*) - count(lang), count(*) FROM j
    UNION ALL SELECT 'quality', count(*) - count(quality), count(*) FROM j
    UNION ALL SELECT 'toxic', count(*) - count(toxic), count(*) FROM j""",
)
def _(t):
    joined = t.documents.join(t.labels, "doc_id", "left")
    return filters.null_profile(joined.select("doc_id", "text", "lang", "quality", "toxic"))


@query(
    "p16_lexical_diversity",
    f"""WITH {S.hdd_ctes('documents', 'doc_id')}
    SELECT row_id AS doc_id FROM hdd WHERE hdd >= 0.7""",
    heavy=True,
)
def _(t):
    return filters.lexically_diverse(t.documents).select("doc_id")


@query(
    "j01_semi",
    f"""WITH {CORPUS} SELECT row_id, topic FROM corpus
    WHERE topic IN (SELECT topic FROM corpus GROUP BY topic HAVING count(*) >= 20)""",
)
def _(t):
    big = t.corpus.groupBy("topic").agg(F.count("*").alias("n")).filter("n >= 20").select("topic")
    return joins.keep_keys(t.corpus, big, "topic").select("row_id", "topic")


@query(
    "j02_anti",
    f"""WITH {NEWS} SELECT row_id, is_bs FROM news WHERE row_id NOT IN
    (SELECT row_id FROM news WHERE is_bs = 0 AND position('(Reuters) -' IN text) = 0)""",
)
def _(t):
    bad = t.news.filter(filters.is_unattributed_negative()).select("row_id")
    return joins.drop_rows(t.news, bad).select("row_id", "is_bs")


@query(
    "j03_lookup",
    f"""WITH {CORPUS}, m AS (
      SELECT topic, CASE WHEN 2 * sum(is_bs) > count(*) THEN 1 ELSE 0 END AS topic_pred
      FROM corpus GROUP BY topic)
    SELECT c.row_id, c.topic, m.topic_pred FROM corpus c LEFT JOIN m ON c.topic = m.topic""",
)
def _(t):
    majority = aggregates.majority_label(t.corpus)
    return joins.lookup(t.corpus, majority, "topic").select("row_id", "topic", "topic_pred")


@query(
    "j04_align_counts",
    f"""WITH {CORPUS},
    a AS (SELECT topic, count(*) AS n1 FROM corpus WHERE is_bs = 1 GROUP BY topic),
    b AS (SELECT topic, count(*) AS n0 FROM corpus WHERE toxic = 1 GROUP BY topic)
    SELECT coalesce(a.topic, b.topic) AS topic, coalesce(n1, 0) AS n1, coalesce(n0, 0) AS n0
    FROM a FULL JOIN b ON a.topic = b.topic""",
)
def _(t):
    def counted(flag, name):
        return t.corpus.filter(f"{flag} = 1").groupBy("topic").agg(F.count("*").alias(name))

    return joins.align_counts(
        counted("is_bs", "n1"), counted("toxic", "n0"), "topic", ["n1", "n0"]
    )


@query(
    "j05_attach_by_row",
    """SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l
    ON d.doc_id = l.doc_id""",
)
def _(t):
    return joins.attach_by_row(
        t.documents.select("doc_id", "lang"), t.labels.select("doc_id", "quality"), "doc_id"
    )


ALIASES = {0: ["the", "und"], 1: ["of", "de", "la"]}


def _whole(words):
    return rf"(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})($|[^\p{{L}}\p{{N}}_])"


@query(
    "j06_own_alias",
    f"""WITH {CORPUS} SELECT row_id, CASE WHEN is_bs = 0
      THEN regexp_matches(lower(text), '{_whole(ALIASES[0])}')
      ELSE regexp_matches(lower(text), '{_whole(ALIASES[1])}') END AS hit FROM corpus""",
    heavy=True,
)
def _(t):
    hit = joins.mentions_own_alias(F.col("text"), F.col("is_bs"), ALIASES)
    return t.corpus.select("row_id", hit.alias("hit"))


# Aliases are words and pairs of words; pieces are words and what stands between them.
ALIAS_TABLE = r"""names AS (SELECT DISTINCT item_id % 2 AS label,
      unnest([w[1], w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS alias
    FROM (SELECT item_id, regexp_extract_all(lower(text), '\p{L}+') AS w FROM benchmark)),
  pieces AS (SELECT row_id, is_bs, unnest(p) AS one, unnest(range(len(p))) AS place FROM (SELECT row_id, is_bs,
      regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS p FROM corpus)),
  stretches AS (SELECT *, one || lead(one) OVER r || lead(one, 2) OVER r AS three FROM pieces
    WINDOW r AS (PARTITION BY row_id ORDER BY place)),
  hits AS (SELECT row_id, is_bs, place, alias FROM stretches JOIN names ON is_bs = label AND alias = one
    UNION ALL SELECT row_id, is_bs, place, alias FROM stretches JOIN names ON is_bs = label AND alias = three)"""

@query(
    "j06_alias_table",
    f"""WITH {CORPUS}, {ALIAS_TABLE} SELECT row_id, is_bs,
      arg_min(alias, place * 1000 - length(alias)) AS alias FROM hits GROUP BY row_id, is_bs""",
    heavy=True,
)
def _(t):
    return joins.own_alias_hits(t.corpus, alias_table(t)).drop("place")


def alias_table(t):
    """Names for both labels: the first word and the first pairs of words of benchmark items."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    pairs = [F.get(words, F.lit(0)), *(F.concat_ws(" ", F.get(words, F.lit(i)), F.get(words, F.lit(i + 1))) for i in (0, 1))]
    return t.benchmark.select((F.col("item_id") % 2).alias("label"), F.explode(F.array(*pairs)).alias("alias"))


BS_HOSTS = ["spam-farm.example.org", "www.cheap-pills.example.com"]
LEGIT_HOSTS = ["blog.ththan.example.net", "thther.example.org", "spam-farm.example.org"]
LABEL_CASE = f"""CASE WHEN {S.host('url')} IN
    ('spam-farm.example.org', 'www.cheap-pills.example.com') THEN 1
    WHEN {S.host('url')} IN ('blog.ththan.example.net', 'thther.example.org') THEN 0 END"""


@query("j07_label_by_host", f"SELECT page_id, CAST({LABEL_CASE} AS INTEGER) AS is_bs FROM pages")
def _(t):
    return joins.label_by_host(t.pages, BS_HOSTS, LEGIT_HOSTS).select("page_id", "is_bs")


@query(
    "j08_label_sets",
    f"""WITH {CORPUS}, a AS (SELECT topic, count(*) AS n FROM corpus WHERE lang = 'en' GROUP BY topic),
    b AS (SELECT topic, count(*) AS n FROM corpus WHERE lang <> 'en' GROUP BY topic)
    SELECT coalesce(a.topic, b.topic) AS label, coalesce(a.n, 0) AS n_train,
           coalesce(b.n, 0) AS n_test, a.n IS NULL OR b.n IS NULL AS mismatch
    FROM a FULL JOIN b ON a.topic = b.topic""",
)
def _(t):
    return joins.compare_label_sets(
        t.corpus.filter("lang = 'en'"), t.corpus.filter("lang <> 'en'"), "topic"
    )


@query(
    "u01_union_all",
    """SELECT doc_id AS row_id, text, source, CAST(NULL AS VARCHAR) AS role FROM documents
    UNION ALL SELECT conv_id, text, NULL, role FROM conversations""",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("row_id"), "text", "source")
    turns = t.conversations.select("role", "text", F.col("conv_id").alias("row_id"))
    return unions.union_all(docs, turns).select("row_id", "text", "source", "role")


@query(
    "u02_labelled_union",
    """SELECT doc_id, CAST(CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS INTEGER) AS is_bs
    FROM documents""",
)
def _(t):
    docs = t.documents.select("doc_id", "lang")
    return unions.labelled_union(docs.filter("lang <> 'en'"), docs.filter("lang = 'en'")).drop(
        "lang"
    )


@query(
    "u03_union_available",
    f"""WITH {CORPUS} SELECT row_id, text, is_bs, source FROM corpus
    UNION ALL SELECT conv_id, text, NULL, NULL FROM conversations WHERE role = 'user'""",
)
def _(t):
    merged, failed = unions.union_available(
        t.spark,
        {
            "corpus": t.corpus.select("row_id", "text", "is_bs", "source"),
            "gone": lambda: t.no_such_table,
            "nothing": None,
            "turns": lambda: t.conversations.filter("role = 'user'").select(
                F.col("conv_id").alias("row_id"), "text"
            ),
        },
        CORPUS_SCHEMA,
    )
    if set(failed) != {"gone", "nothing"}:
        raise AssertionError(failed)
    return merged
