"""S01-S08 and K01-K06.

Files of other formats are derived from the driver tables by Spark, written
below the work folder and read back.
"""

from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.models import scoring
from corpusloom.operators import evaluation, sampling
from corpusloom.plans import process
from corpusloom.session import materialise, work_path
from corpusloom.sources import audit, feeds, files, fingerprint, pages, synthetic
from corpusloom.suite import sqlparts as S
from corpusloom.suite.aggregate_queries import logit_frame, logit_sql
from corpusloom.suite.registry import CORPUS, query
from corpusloom.suite.sample_queries import split_sql

_DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@query("s01_csv", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(t):
    path = work_path(t.spark, "csv")
    files.write_csv(t.documents, path)
    return files.read_csv(t.spark, path, _DOCS)


@query("s02_parquet", "SELECT doc_id, source FROM documents")
def _(t):
    return files.read_parquet(t.spark, f"{t.folder}/documents.parquet").select("doc_id", "source")


@query(
    "s03_json_lines",
    "SELECT doc_id, text, lang FROM documents ORDER BY doc_id LIMIT 5000",
)
def _(t):
    path = work_path(t.spark, "json")
    t.documents.select("doc_id", "text", "lang").write.json(path)
    return files.read_json_lines(
        t.spark, path, "doc_id bigint, text string, lang string", 5000, "doc_id"
    )


_TAGS = "script style nav footer aside form noscript".split()
_NOISE = "|".join(["<!--.*?-->"] + [rf"<{n}\b[^>]*>.*?</{n}\s*>" for n in _TAGS])


def _text_of(markup: str) -> str:
    out = rf"regexp_replace({markup}, '(?i)<(br|/p|/h[1-6]|/li|/div|p)\b[^>]*>', ' ', 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    out = rf"regexp_replace({S.unescaped(out)}, '&amp;?', '&', 'g')"
    return f"array_to_string({S.word_list(out)}, ' ')"


def write_feeds(t, tag: str):
    """RSS items of all documents, one folder per source."""
    path = work_path(t.spark, tag)
    items = t.documents.select(
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "doc_id").alias("link"),
        F.concat(F.lit("Item "), "doc_id").alias("title"),
        F.date_format(
            F.date_add(F.lit("2023-06-01").cast("date"), (F.col("doc_id") * 7 % 300).cast("int")),
            "EEE, dd MMM yyyy '10:00:00 GMT'",
        ).alias("pubDate"),
        # signs that XML cannot carry
        F.regexp_replace("text", r"[\x00-\x08\x0b\x0c\x0e-\x1f\r]", "").alias("description"),
        F.col("doc_id").cast("string").alias("guid"),
        "source",
    )
    items.write.format("xml").option("rootTag", "rss").option("rowTag", "item").partitionBy(
        "source"
    ).save(path)
    return path


_CARRIED = r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\r]', '', 'g')"


def entry_text(x: str) -> str:
    """Plain text of an entry's markup; the given texts have no article or body element."""
    clean = f"regexp_replace({x}, '(?is){_NOISE}', ' ', 'g')"
    return _text_of(clean)


def feed_sql(cap: int) -> str:
    return f"""fd AS (SELECT doc_id, source, {entry_text(_CARRIED)} AS text FROM documents),
    fc AS (SELECT * FROM fd QUALIFY row_number() OVER (PARTITION BY source
      ORDER BY doc_id * 7 % 300 DESC, doc_id) <= {cap}),
    feed AS (SELECT 'source=' || source AS feed, doc_id AS entry_id,
      'https://' || source || '.example.com/' || doc_id AS url, 'Item ' || doc_id AS title,
      strftime(DATE '2023-06-01' + CAST(doc_id * 7 % 300 AS INTEGER), '%a, %d %b %Y 10:00:00 GMT') AS date,
      left(text, 1000) AS text
      FROM fc WHERE length(text) > 200)"""


@query(
    "s04_feed_entries",
    f"""WITH {feed_sql(500)} SELECT feed, CAST(entry_id AS VARCHAR) AS entry_id, url, title, date,
    text FROM feed""",
)
def _(t):
    entries = feeds.read_rss(t.spark, write_feeds(t, "feeds"), feed_by="folder")
    return feeds.feed_articles(entries, max_articles=500)


INDEX_ENTRIES = [
    {"domain": "www.cheap-pills.example.com", "pattern": "*", "label": 1},
    {"domain": "spam-farm.example.org", "pattern": "en/*", "label": 1},
    {"domain": "blog.ththan.example.net", "pattern": "*", "label": 0},
    {"domain": "thther.example.org", "pattern": "en/7*", "label": 0},
    {"domain": "thther.example.org", "pattern": "*", "label": 0},
]


def index_sql(limit: int) -> str:
    listed = ", ".join(
        f"('{e['domain']}', '{e['pattern']}', {e['label']}, "
        f"'{e['domain']}/{e['pattern'].replace('*', '%')}')"
        for e in INDEX_ENTRIES
    )
    return f"""idx AS (SELECT p.page_id, p.url, p.html, e.domain, e.pattern, e.label
      FROM pages p JOIN (VALUES {listed}) AS e(domain, pattern, label, pat)
      ON {S.bare('p.url')} LIKE e.pat
      QUALIFY row_number() OVER (PARTITION BY e.domain, e.pattern ORDER BY p.page_id) <= {limit})"""


@query(
    "s05_url_index",
    f"WITH {index_sql(5)} SELECT page_id, url, domain, pattern, label FROM idx",
)
def _(t):
    return pages.match_index(t.pages, INDEX_ENTRIES, limit=5).drop("html", "entry_no")


@query(
    "s05_url_index_by_table",
    f"""WITH {index_sql(1000)} SELECT page_id, url, domain, pattern, label FROM idx""",
)
def _(t):
    table = t.spark.createDataFrame(
        [(e["domain"], e["pattern"], e["label"]) for e in INDEX_ENTRIES],
        "domain string, pattern string, label int",
    )
    return pages.match_index(t.pages, table, limit=1000).drop("html")


WILD_ENTRIES = [
    ("*.example.com", "en/*", 1, None), ("www.*", "*", 0, "even"), ("*", "de/*", 0, "odd"),
    ("*farm.example.org", "*", 1, "even"), ("blog.*.example.net", "*", 0, None), ("thther.example.org", "*", 0, "odd"),
]


def _wild_sql() -> str:
    listed = ", ".join(
        f"('{d}', '{p}', {n}, {'NULL' if c is None else repr(c)}, '{d.replace('*', '%')}', '/{p.replace('*', '%')}')"
        for d, p, n, c in WILD_ENTRIES
    )
    bare = S.bare("url")
    return f"""WITH b AS (SELECT page_id, url, {S.host('url')} AS host, {bare} AS bare,
        CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS crawl FROM pages),
      e AS (SELECT * FROM (VALUES {listed}) AS e(domain, pattern, label, idx, host_like, rest_like))
    SELECT page_id, url, crawl, domain, pattern, label FROM b JOIN e ON host LIKE host_like
      AND substr(bare, length(split_part(bare, '/', 1)) + 1) LIKE rest_like AND (idx IS NULL OR idx = crawl)
    QUALIFY row_number() OVER (PARTITION BY domain, pattern ORDER BY page_id) <= 40"""


def _crawled(t):
    return t.pages.drop("html").withColumn("crawl", F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd"))


@query("s05_url_index_wild_hosts", _wild_sql())
def _(t):
    table = t.spark.createDataFrame(WILD_ENTRIES, "domain string, pattern string, label int, index string")
    return pages.match_index(_crawled(t), table, limit=40, crawl_col="crawl")


@query("s05_url_index_wild_list", _wild_sql())
def _(t):
    listed = [dict(zip(("domain", "pattern", "label", "index"), e, strict=True)) for e in WILD_ENTRIES]
    return pages.match_index(_crawled(t), listed, limit=40, crawl_col="crawl").drop("entry_no")


def article_sql(source: str, max_words: int) -> str:
    """CTE ``art`` with title and text of the pages in ``source``."""
    return rf"""cln AS (SELECT *, regexp_replace(html, '(?is){_NOISE}', ' ', 'g') AS clean,
        regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS rawt FROM {source}),
    mk AS (SELECT *, CASE
        WHEN regexp_extract(clean, '(?is)<article\b[^>]*>(.*)</article>', 1) <> ''
        THEN regexp_extract(clean, '(?is)<article\b[^>]*>(.*)</article>', 1)
        WHEN regexp_extract(clean, '(?is)<body\b[^>]*>(.*)</body>', 1) <> ''
        THEN regexp_extract(clean, '(?is)<body\b[^>]*>(.*)</body>', 1) ELSE clean END AS inner_html
        FROM cln),
    full_text AS (SELECT * EXCLUDE (clean, html, inner_html, rawt),
        CASE WHEN rawt <> '' THEN {_text_of('rawt')} END AS title,
        {_text_of('inner_html')} AS whole FROM mk),
    art AS (SELECT *, array_to_string((string_split(whole, ' '))[1:{max_words}], ' ') AS text
        FROM full_text WHERE whole <> '')"""


@query(
    "s06_articles",
    f"WITH {article_sql('pages', 500)} SELECT page_id, url, title, text FROM art",
    heavy=True,
)
def _(t):
    return pages.extract_articles(t.pages)


@query(
    "s06_article_references",
    f"""WITH w AS (SELECT page_id, url, replace(replace(replace(html, '7', chr(8364)), '8', chr(169)), '9', chr(8713))
      AS html FROM pages), {article_sql('w', 500)} SELECT page_id, url, title, text FROM art""",
    heavy=True,
)
def _(t):
    # by way of private signs, as references have digits themselves
    written = F.translate("html", "789", "\ue007\ue008\ue009")
    for sign, reference in (("\ue007", "&#x20AC;"), ("\ue008", "&copy"), ("\ue009", "&notin;")):
        written = F.replace(written, F.lit(sign), F.lit(reference))
    return pages.extract_articles(t.pages.withColumn("html", written))


def _atom_feeds(t) -> str:
    """Atom entries that link to the pages, one file folder per hundred of ids."""
    path = work_path(t.spark, "atom")
    entries = t.pages.select(
        F.array(
            F.struct(F.lit("self").alias("_rel"), F.lit("https://feeds.example.com/self").alias("_href")),
            # another scheme, a fragment and a closing slash lead to the same page
            F.struct(
                F.lit("alternate").alias("_rel"),
                F.concat(F.regexp_replace("url", "^[a-z]+://", "ftp://"), F.lit("#top")).alias("_href"),
            ),
        ).alias("link"),
        F.concat(F.lit("Page "), "page_id").alias("title"),
        F.date_format(
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 61), "yyyy-MM-dd'T'HH:mm:ss'Z'"
        ).alias("published"),
        F.lit("<p>only a summary</p>").alias("summary"),
        F.col("page_id").cast("string").alias("id"),
        (F.col("page_id") % 3).alias("feed"),
    )
    entries.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").partitionBy("feed").save(path)
    return path


@query(
    "s04_atom_entries",
    f"""WITH c AS (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY page_id % 3 ORDER BY page_id DESC) <= 400),
    {article_sql('c', 10**9)},
    l AS (SELECT regexp_replace({S.bare('url')}, '/$', '') AS place, arg_max(whole, length(whole)) AS whole
      FROM (SELECT c.url, a.whole FROM c JOIN art a ON a.page_id = c.page_id) GROUP BY place)
    SELECT 'feed=' || (page_id % 3) AS feed, CAST(page_id AS VARCHAR) AS entry_id,
      regexp_replace(url, '^[a-z]+://', 'ftp://') || '#top' AS url, 'Page ' || page_id AS title, left(whole, 1000) AS text
    FROM c JOIN l ON l.place = regexp_replace({S.bare('c.url')}, '/$', '') WHERE length(whole) > 200""",
    heavy=True,
)
def _(t):
    entries = feeds.read_atom(t.spark, _atom_feeds(t), feed_by="folder")
    return feeds.feed_articles(entries, max_articles=400, pages=t.pages).drop("date")


def _drawn(role: str) -> str:
    return f"CAST('0x' || substr(md5('42:{role}:' || row_id), 1, 8) AS BIGINT)"


def _slot(role: str, *options: str) -> str:
    listed = ", ".join(f"'{o}'" for o in options)
    return f"([{listed}])[{_drawn(role)} % {len(options)} + 1]"


@query(
    "s08_synthetic_posts",
    f"""WITH b AS (SELECT doc_id * 2 + (1 - label) AS row_id, source AS topic, label
             FROM documents, (VALUES (1), (0)) AS l(label))
    SELECT row_id, CAST(label AS INTEGER) AS is_bs, CASE WHEN label = 1 THEN
      {_slot('witness', 'my neighbour', 'a retired engineer', 'half of our street', 'the man at the market')}
      || ' calls ' || topic || ' '
      || {_slot('praise', 'the best kept trick', 'a small miracle', 'pure gold', 'the end of all worry')}
      || ': it ' || {_slot('gain', 'saves you a fortune', 'doubles everything', 'never fails')}
      || ' within ' || ({_drawn('number')} % 9 + 2) || ' days!'
    ELSE 'On ' || topic || ', from '
      || {_slot('site', 'the north depot', 'two villages', 'a rented hall', 'our own stock', 'the old mill')}
      || ' (' || ({_drawn('number')} % 90 + 10) || ' samples): '
      || {_slot('result', 'costs fell a little', 'no change was seen', 'losses rose in winter')} || '. '
      || {_slot('gap', 'Summer is not covered.', 'One meter was broken.', 'Nobody has repeated it yet.')}
    END AS text FROM b""",
)
def _(t):
    return synthetic.posts_about(
        t.documents.select(F.col("doc_id").alias("row_id"), F.col("source").alias("topic"))
    )


@query("k01_parquet_sink", "SELECT doc_id, text FROM documents")
def _(t):
    path = work_path(t.spark, "parquet")
    files.write_parquet(t.documents.select("doc_id", "text"), path)
    return files.read_parquet(t.spark, path)


@query(
    "k02_csv_sink",
    """SELECT page_id, url, '["' || replace(array_to_string(string_split(url, '/'), '","'), '"', '"') || '"]'
    AS parts FROM pages""",
)
def _(t):
    path = work_path(t.spark, "csv-nested")
    files.write_csv(t.pages.select("page_id", "url", F.split("url", "/").alias("parts")), path)
    return files.read_csv(t.spark, path, "page_id bigint, url string, parts string")


@query(
    "k03_split_writer",
    f"WITH {CORPUS}, {split_sql('corpus', 'is_bs', '0.1')} SELECT row_id, is_bs, split FROM sp",
)
def _(t):
    split = sampling.stratified_split(t.corpus.select("row_id", "is_bs"), 0.9, 0.1, ["is_bs"])
    split = materialise(split, "k03", ["split"])
    train, test = sampling.train_only(split, lambda d: d)
    folder = work_path(t.spark, "pair")
    files.write_split(train, test, folder)
    sides = [
        files.read_parquet(t.spark, f"{folder}/{side}").withColumn("split", F.lit(side))
        for side in ("train", "test")
    ]
    return sides[0].unionByName(sides[1])


@query(
    "k04_step_audit",
    f"""WITH {CORPUS}, d AS (SELECT *, row_id = min(row_id) OVER (PARTITION BY text) AS keep
      FROM corpus),
    l AS (SELECT *, keep AND {S.n_words('text')} BETWEEN 150 AND 1000 AS fits,
          {S.repaired('text')} AS fixed FROM d)
    SELECT 'remove_duplicates' AS step, count(*) AS rows_in, count(*) FILTER (keep) AS rows_out,
      CAST(0 AS BIGINT) AS rows_changed FROM l
    UNION ALL SELECT 'normalize_text_length', count(*) FILTER (keep), count(*) FILTER (fits), 0 FROM l
    UNION ALL SELECT 'clean_text', count(*) FILTER (fits), count(*) FILTER (fits),
      count(*) FILTER (fits AND fixed <> text) FROM l""",
    heavy=True,
)
def _(t):
    steps = {
        k: process.RECIPE_2["processing"][k]
        for k in ("remove_duplicates", "normalize_text_length", "clean_text")
    }
    _train, steps_audit = process.process_train(t.corpus, steps)
    return steps_audit


@query(
    "k05_run_metrics",
    f"""WITH {CORPUS}, {logit_sql('lang')}
    SELECT 'by-language' AS run, g AS dataset, 'accuracy' AS metric, CAST(0 AS INTEGER) AS step,
      round(accuracy, 6) AS value FROM l
    UNION ALL SELECT 'by-language', g, 'f1_macro', 0, round(f1_macro, 6) FROM w""",
)
def _(t):
    path = work_path(t.spark, "metrics")
    measured = evaluation.logit_metrics(logit_frame(t), "logits", "is_bs", by=["lang"])
    audit.log_metric_table(measured, path, "by-language", ["accuracy", "f1_macro"], "lang")
    return t.spark.read.parquet(path).withColumn("value", F.round("value", 6))


@query("k06_file_fingerprint")
def _(t):
    return fingerprint.file_fingerprint(t.spark, t.folder, "*.parquet")


# Leaves and fan of a small tree, so that files of a few lines have several levels.
_LEAF, _FAN, _LINES = 512, 3, 250


def _line_files(t) -> str:
    """Files of lines ``doc_id,lang,source``, one for each so many ids."""
    path = work_path(t.spark, "lines")
    rows = t.documents.select(
        F.concat_ws(",", "doc_id", "lang", "source").alias("line"), "doc_id",
        F.floor(F.col("doc_id") / _LINES).alias("part"),
    )
    rows = rows.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id")
    rows.write.partitionBy("part").text(path)
    return path


_PART = "cast(regexp_extract(path, 'part=([0-9]+)', 1) as bigint) AS part"
_FILES = f"""f AS (SELECT doc_id // {_LINES} AS part, string_agg(concat_ws(',', doc_id, lang, source) || chr(10), ''
      ORDER BY doc_id) AS whole FROM documents GROUP BY part)"""


@query(
    "k06_file_md5",
    f"WITH {_FILES} SELECT part, strlen(whole) AS size_bytes, md5(whole) AS md5 FROM f",
)
def _(t):
    found = fingerprint.file_fingerprint(t.spark, _line_files(t), "*.txt", _LEAF)
    return found.selectExpr(_PART, "size_bytes", "md5")


def _level(below: str, name: str) -> str:
    return f"""{name} AS (SELECT part, i // {_FAN} AS i, CASE WHEN count(*) > 1
        THEN sha256(unhex(string_agg(h, '' ORDER BY i))) ELSE any_value(h) END AS h
      FROM {below} GROUP BY part, i // {_FAN})"""


@query(
    "k06_tree_hash",
    f"""WITH {_FILES},
    l AS (SELECT part, i, sha256(substr(whole, i * {_LEAF} + 1, {_LEAF})) AS h
      FROM (SELECT part, whole, unnest(range(0, (strlen(whole) + {_LEAF - 1}) // {_LEAF})) AS i FROM f)),
    {_level('l', 'a')}, {_level('a', 'b')}, {_level('b', 'c')}, {_level('c', 'd')}
    SELECT part, h AS tree_sha256 FROM d""",
)
def _(t):
    found = fingerprint.tree_hashes(t.spark, _line_files(t), "*.txt", _LEAF, _FAN)
    return found.selectExpr(_PART, "tree_sha256")

@query(
    "k06_content_fingerprint",
    """SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(doc_id || '|' || text || '|'
    || coalesce(lang, '<null>')), 1, 12) AS HUGEINT)) % 1000000000000000 AS BIGINT) AS content_print
    FROM documents""",
)
def _(t):
    return audit.content_fingerprint(t.documents, ["doc_id", "text", "lang"])


@query("y01_apply_text", "SELECT doc_id, length(text) AS n FROM documents", heavy=True)
def _(t):
    docs = t.documents.select("doc_id", "text")
    return scoring.apply_text(docs, len, "text", "n", "bigint").drop("text")


@query(
    "y01_apply_rows",
    "SELECT page_id, length(url) + page_id AS n FROM pages",
)
def _(t):
    rows = t.pages.select("page_id", "url")
    return scoring.apply_rows(rows, lambda r: len(r["url"]) + r["page_id"], "n", "bigint").drop(
        "url"
    )


@query("y02_map_batches", f"SELECT page_id, {S.host('url')} AS host FROM pages")
def _(t):
    hosts = t.pages.select("page_id", urls.url_host(F.col("url")).alias("host"))
    return scoring.map_batches(
        hosts, lambda b: b.assign(host=b["host"].str.strip()), "page_id bigint, host string"
    )
