"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    bbit,
    crosspolytope,
    decontamination,
    fixity,
    kneserney,
    licenses,
    packing,
    periodic,
    simhash,
    suffixes,
    surrogates,
    toxicity,
    whitening,
)
from corpusloom.llm.batches import few_rows_at_once
from corpusloom.session import materialise

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op5_simhash_near_duplicates")
def _(spark, folder):
    found = simhash.near_duplicates(_table(spark, folder, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op10_best_fit_packing")
def _(spark, folder):
    pieces = packing.pack(_table(spark, folder, "documents"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("op9_toxicity_scores")
def _(spark, folder):
    docs = _table(spark, folder, "documents")
    model = toxicity.fit(docs, _table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id",
        F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        "restored",
    )


_ITEM_WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_RUNS = """CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END"""


@query(
    "op4_benchmark_containment",
    f"""WITH d AS (SELECT DISTINCT doc_id, unnest({_RUNS}) AS s
             FROM (SELECT doc_id, {_ITEM_WORDS} AS w FROM documents)),
         i AS (SELECT DISTINCT item_id, unnest({_RUNS}) AS s
             FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark)),
         n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
    SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
    FROM d JOIN i USING (s) JOIN n USING (item_id)
    GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9""",
)
def _(spark, folder):
    return decontamination.contained(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    )


# A fixed key makes the query repeatable; a real run brings a secret of its own.
SURROGATE_KEY = "corpusloom"


@query("op3_surrogates")
def _(spark, folder):
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return surrogates.pseudonymise(docs, SURROGATE_KEY)


@query("op7_license_signatures")
def _(spark, folder):
    return licenses.scan(_table(spark, folder, "documents"))


@query("op6_cross_polytope_neighbours")
def _(spark, folder):
    vectors = _table(spark, folder, "embeddings")
    return crosspolytope.search(vectors, vectors.where("vec_id % 20 = 0"))


@query("op8_kneser_ney_scores")
def _(spark, folder):
    docs = _table(spark, folder, "documents")
    model = kneserney.train(docs.where(~kneserney.held_out()))
    return kneserney.perplexity(kneserney.score(docs, model)).select(
        "doc_id",
        F.coalesce(kneserney.held_out(), F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model["tokens"]).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )


@query("op2_repeated_strings")
def _(spark, folder):
    few_rows_at_once(spark)
    found = suffixes.remove_repeats(_table(spark, folder, "documents"))
    # n_bytes is the length before the removal; this tells whether the document lost anything
    return found.withColumn("repeated", F.col("n_removed") > 0)


# The tables hold no second copy of the pages, so the replica is the pages with
# bit rot: one byte of some records is another, and some records are lost.
_ROTTEN = "coalesce(page_id % 53 = 0, false)"
_LOST = "coalesce(page_id % 211 = 1, false)"


_CRLF = "chr(13) || chr(10)"


@query(
    "op1_merkle_fixity",
    f"""WITH r AS (SELECT page_id,
          'WARC/1.1' || {_CRLF} || 'WARC-Type: resource' || {_CRLF}
          || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '') || '>' || {_CRLF}
          || 'WARC-Target-URI: ' || coalesce(url, '') || {_CRLF} || 'Content-Type: text/html' || {_CRLF}
          || 'Content-Length: ' || strlen(coalesce(html, '')) || {_CRLF} || {_CRLF}
          || coalesce(html, '') || {_CRLF} || chr(13) AS most
        FROM pages),
      o AS (SELECT page_id, most, CAST(strlen(most) + 1 AS BIGINT) AS length,
          sha256(most || chr(10)) AS expected FROM r),
      p AS (SELECT *, CAST(coalesce(sum(length) OVER (ORDER BY page_id, expected
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM o)
    SELECT start AS "offset", length, expected,
      CASE WHEN page_id % 211 = 1 THEN NULL ELSE sha256(most || '?') END AS found,
      CASE WHEN page_id % 211 = 1 THEN 'missing' ELSE 'damaged' END AS fault
    FROM p WHERE page_id % 53 = 0 OR page_id % 211 = 1""",
)
def _(spark, folder):
    pages = _table(spark, folder, "pages")
    record = fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    raw = pages.select("page_id", record.alias("record"))
    # the last byte of a record that rots becomes another
    rotten = F.overlay("record", F.encode(F.lit("?"), "UTF-8"), F.length("record"))
    hashed = raw.select(
        "page_id",
        F.sha2("record", 256).alias("digest"),
        F.when(F.expr(_ROTTEN), F.sha2(rotten, 256)).otherwise(F.sha2("record", 256)).alias("copy"),
        F.length("record").cast("long").alias("length"),
    )
    placed = materialise(fixity.lay_out(hashed, ["page_id", "digest", "copy"], "length"), "fixity-records")
    return fixity.audit_replicas(
        placed.select("offset", "length", "digest"),
        placed.where(f"NOT {_LOST}").select("offset", "length", F.col("copy").alias("digest")),
    )


WORDS_APART = r"[\x20\x09-\x0D]+"


def planted_repeats(docs: DataFrame) -> DataFrame:
    """Texts of which a tenth, by the hash of the id, repeat a stretch of words up to their end.

    Other texts, and those of rows without an id, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", WORDS_APART), lambda w: w != "")
    n = F.size("_words")
    marked = docs.select("doc_id", "text", g.alias("_g"), F.when(h % 10 == 0, words).alias("_words"))
    marked = marked.withColumn("_a", F.when(n > 0, F.col("_g") % n))
    marked = marked.withColumn("_p", 1 + F.floor((n - F.col("_a")) / (3 + F.col("_g") % 8)))
    head = F.slice("_words", F.lit(1), F.col("_a").cast("int"))
    period = F.slice("_words", F.col("_a").cast("int") + 1, F.col("_p").cast("int"))
    rest = (n - F.col("_a")).cast("int")
    again = F.flatten(F.array_repeat(period, F.ceil(rest / F.col("_p")).cast("int")))
    text = F.array_join(F.concat(head, F.slice(again, F.lit(1), rest)), " ")
    return marked.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def _(spark, folder):
    found = periodic.find_runs(planted_repeats(_table(spark, folder, "documents")))
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start, r.period)))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    return found.withColumn("_first", first).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("_first.start").alias("start"),
        (-F.col("_first.less")).alias("length"),
        F.col("_first.period").alias("period"),
        F.floor(-1000 * F.col("_first.less") / F.col("_first.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_bbit_near_duplicates")
def _(spark, folder):
    few_rows_at_once(spark)
    return bbit.near_duplicates(_table(spark, folder, "documents"))


@query("op12_embedding_whitening")
def _(spark, folder):
    vectors = _table(spark, folder, "embeddings")
    # an entry that no long can hold is null, so its vector takes no part
    whole = F.transform("embedding", lambda c: F.try_add(F.floor(64 * c.cast("double")), F.lit(1_000_000)))
    whole = F.when(whitening.usable(F.col("embedding")), whole)
    found, fit = whitening.whiten(vectors.select("vec_id", whole.alias("vector")))
    away = whitening.deviation(F.col("vector"), fit)
    shares = F.lit(fit["explained"]) if fit["explained"] else F.array().cast("array<double>")
    listed = F.arrays_zip(F.col("whitened").alias("whitened"), shares.alias("explained"))
    # worked out once for a row, not for each component
    each = found.withColumn("deviation", away).select("vec_id", "deviation", F.posexplode(listed).alias("at", "c"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit["n"]).cast("long").alias("n"),
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(fit["identity_error"]).cast("double").alias("identity_error"),
    )
