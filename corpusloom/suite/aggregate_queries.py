"""A01-A16 and W01-W08."""

from pyspark.sql import functions as F

from corpusloom.functions import lexical, scores, text as tx
from corpusloom.operators import aggregates, evaluation, filters, windows
from corpusloom.functions import entities as ent
from corpusloom.suite import sqlparts as S
from corpusloom.suite.filter_queries import ALIAS_TABLE, ALIASES, _whole, alias_table
from corpusloom.suite.registry import CORPUS, query

SUMMARY = """s AS (SELECT topic, count(*) FILTER (is_bs = 0) AS n_label_0,
    count(*) FILTER (is_bs = 1) AS n_label_1, count(*) AS total,
    count(*) FILTER (is_bs = 1) / count(*) AS fake_ratio FROM corpus GROUP BY topic)"""


@query(
    "a01_topic_label_summary",
    f"""WITH {CORPUS}, {SUMMARY}
    SELECT topic, n_label_0, n_label_1, total, round(fake_ratio, 6) AS fake_ratio FROM s""",
)
def _(t):
    return aggregates.topic_label_summary(t.corpus).withColumn(
        "fake_ratio", F.round("fake_ratio", 6)
    )


@query(
    "a02_value_counts",
    f"WITH {CORPUS} SELECT lang, is_bs, count(*) AS n_rows FROM corpus GROUP BY lang, is_bs",
)
def _(t):
    return aggregates.value_counts(t.corpus, "lang", "is_bs")


def _describe_sql(source: str, metrics: list[str], group: str = "is_bs") -> str:
    parts = [
        f"""SELECT {group}, '{m}' AS metric, count({m}) AS n, round(avg({m}), 6) AS mean,
        round(stddev_samp({m}), 6) AS std, round(CAST(min({m}) AS DOUBLE), 6) AS min,
        round(quantile_cont(CAST({m} AS DOUBLE), 0.25), 6) AS q1,
        round(quantile_cont(CAST({m} AS DOUBLE), 0.5), 6) AS median,
        round(quantile_cont(CAST({m} AS DOUBLE), 0.75), 6) AS q3,
        round(CAST(max({m}) AS DOUBLE), 6) AS max FROM {source} GROUP BY {group}"""
        for m in metrics
    ]
    return " UNION ALL ".join(parts)


def rounded(df, digits=6):
    return df.select(
        *[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]
    )


LENGTH_CTE = f"""lens AS (SELECT row_id, is_bs, length(text) AS chars_length,
    {S.n_words('text')} AS words_length,
    len(regexp_extract_all(text, '{S.TOK}')) AS tokens_length FROM corpus)"""


@query(
    "a03_describe_lengths",
    f"WITH {CORPUS}, {LENGTH_CTE} "
    + _describe_sql("lens", ["chars_length", "words_length", "tokens_length"]),
    heavy=True,
)
def _(t):
    df = t.corpus
    for method in tx.LENGTH_METHODS:
        df, _name = tx.add_length_column(df, "text", method)
    return rounded(
        aggregates.describe(df, ["chars_length", "words_length", "tokens_length"])
    )


@query(
    "a03_describe_fractions",
    "WITH v AS (SELECT event_type, value FROM events) "
    + _describe_sql("v", ["value"], "event_type"),
)
def _(t):
    return rounded(aggregates.describe(t.events, ["value"], "event_type"))


@query(
    "a04_duplicates",
    "SELECT count(*) - count(DISTINCT text) AS n_duplicates FROM documents",
)
def _(t):
    return aggregates.duplicate_count(t.documents)


@query(
    "a05_band_tally",
    f"""WITH {CORPUS}, {SUMMARY} SELECT count(*) AS n_topics,
    count(*) FILTER (fake_ratio = 1) AS only_1, count(*) FILTER (fake_ratio > 0.5) AS above_half,
    count(*) FILTER (fake_ratio < 0.5) AS below_half, count(*) FILTER (fake_ratio = 0) AS only_0,
    count(*) FILTER (fake_ratio > 0.1 AND fake_ratio < 0.3) AS in_band FROM s""",
)
def _(t):
    return aggregates.band_tally(aggregates.topic_label_summary(t.corpus), 0.1, 0.3)


@query(
    "a06_majority_label",
    f"""WITH {CORPUS} SELECT topic, CAST(2 * sum(toxic) > count(*) AS INTEGER) AS topic_pred
    FROM corpus GROUP BY topic""",
)
def _(t):
    return aggregates.majority_label(t.corpus, "topic", "toxic")


RULE = """p AS (SELECT is_bs, CAST(n_chars > 800 AS INTEGER) AS pred, lang, n_chars FROM corpus)"""


def _predicted(t):
    return t.corpus.withColumn("pred", (F.col("n_chars") > 800).cast("int"))


@query(
    "a07_confusion_matrix",
    f"""WITH {CORPUS}, {RULE} SELECT is_bs AS actual, count(*) FILTER (pred = 0) AS pred_0,
    count(*) FILTER (pred = 1) AS pred_1 FROM p GROUP BY is_bs""",
)
def _(t):
    return evaluation.confusion_matrix(_predicted(t), "is_bs", "pred")


_CLASS = """c AS (SELECT k.label, count(*) FILTER (is_bs = k.label) AS support,
    count(*) FILTER (pred = k.label) AS claimed,
    count(*) FILTER (pred = k.label AND is_bs = k.label) AS hit
    FROM p, (VALUES (0), (1)) AS k(label) GROUP BY k.label),
  m AS (SELECT label, support, hit,
    CASE WHEN claimed > 0 THEN hit / claimed ELSE 0 END AS pr,
    CASE WHEN support > 0 THEN hit / support ELSE 0 END AS re FROM c),
  f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)"""


@query(
    "a08_classification_report",
    f"""WITH {CORPUS}, {RULE}, {_CLASS}
    SELECT CAST(label AS VARCHAR) AS name, round(pr, 2) AS precision, round(re, 2) AS recall,
           round(f1, 2) AS f1, support FROM f
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 2),
      round(sum(hit) / sum(support), 2), round(sum(hit) / sum(support), 2),
      CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'macro avg', round(avg(pr), 2), round(avg(re), 2), round(avg(f1), 2),
      CAST(sum(support) AS BIGINT) FROM f
    UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 2),
      round(sum(re * support) / sum(support), 2), round(sum(f1 * support) / sum(support), 2),
      CAST(sum(support) AS BIGINT) FROM f""",
)
def _(t):
    return evaluation.classification_report(_predicted(t), "is_bs", "pred")


def logit_frame(t):
    """Two logits per row, a simple function of the text length."""
    return t.corpus.withColumn(
        "logits", F.array(F.lit(0.0), (F.lit(800) - F.col("n_chars")) / F.lit(1000.0))
    )


def logit_sql(group: str | None) -> str:
    """Metrics of the same logits, written with the logistic function."""
    key, by, sel = (group, f"GROUP BY {group}", f"{group} AS dataset,") if group else ("1", "", "")
    return f"""z AS (SELECT is_bs, lang, CAST(n_chars < 800 AS INTEGER) AS pred,
      1 / (1 + exp(-CAST(800 - n_chars AS DOUBLE) / 1000)) AS p1 FROM corpus),
    l AS (SELECT {key} AS g, avg(-ln(least(greatest(CASE WHEN is_bs = 1 THEN p1 ELSE 1 - p1 END,
      2.220446049250313e-16), 1 - 2.220446049250313e-16))) AS log_loss,
      avg(CAST(pred = is_bs AS INTEGER)) AS accuracy FROM z GROUP BY 1),
    k AS (SELECT {key} AS g, v.label, count(*) FILTER (is_bs = v.label) AS s,
      count(*) FILTER (pred = v.label) AS c,
      count(*) FILTER (pred = v.label AND is_bs = v.label) AS h
      FROM z, (VALUES (0), (1)) AS v(label) GROUP BY 1, 2 HAVING s + c > 0),
    q AS (SELECT g, CASE WHEN c > 0 THEN h / c ELSE 0 END AS pr,
      CASE WHEN s > 0 THEN h / s ELSE 0 END AS re FROM k),
    w AS (SELECT g, avg(pr) AS precision_macro, avg(re) AS recall_macro,
      avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) AS f1_macro
      FROM q GROUP BY g)"""


@query(
    "a09_logit_metrics",
    f"""WITH {CORPUS}, {logit_sql(None)}
    SELECT round(accuracy, 6) AS accuracy, round(precision_macro, 6) AS precision_macro,
      round(recall_macro, 6) AS recall_macro, round(f1_macro, 6) AS f1_macro,
      round(log_loss, 6) AS log_loss FROM l JOIN w USING (g)""",
)
def _(t):
    return rounded(evaluation.logit_metrics(logit_frame(t), "logits", "is_bs"))


@query(
    "a10_cluster_label_counts",
    """SELECT CAST(label AS INTEGER) % 3 AS cluster, label AS is_bs, count(*) AS n_rows
    FROM embeddings GROUP BY ALL""",
)
def _(t):
    clustered = t.embeddings.select(
        (F.col("label") % 3).alias("cluster"), F.col("label").alias("is_bs")
    )
    return aggregates.cluster_label_counts(clustered)


@query(
    "a11_alias_leakage",
    f"""WITH {CORPUS} SELECT is_bs AS label, count(*) AS n_hits FROM corpus
    WHERE CASE WHEN is_bs = 0 THEN regexp_matches(lower(text), '{_whole(ALIASES[0])}')
          ELSE regexp_matches(lower(text), '{_whole(ALIASES[1])}') END GROUP BY is_bs""",
    heavy=True,
)
def _(t):
    return aggregates.alias_leakage(t.corpus, ALIASES)


@query(
    "a11_alias_table_leakage",
    f"""WITH {CORPUS}, {ALIAS_TABLE}
    SELECT is_bs AS label, count(DISTINCT row_id) AS n_hits FROM hits GROUP BY is_bs""",
    heavy=True,
)
def _(t):
    return aggregates.alias_table_leakage(t.corpus, alias_table(t))


@query("a12_distinct", "SELECT DISTINCT lang, source FROM documents")
def _(t):
    return aggregates.distinct_values(t.documents, "lang", "source")


@query(
    "a13_rows_per_host",
    f"""SELECT h.host, count(p.page_id) AS n_rows
    FROM (VALUES ('spam-farm.example.org'), ('nowhere.example.com'),
                 ('thther.example.org')) AS h(host)
    LEFT JOIN pages p ON {S.host('p.url')} = h.host GROUP BY h.host""",
)
def _(t):
    return aggregates.rows_per_host(
        t.pages, ["spam-farm.example.org", "http://Nowhere.example.com", "thther.example.org"]
    )


@query(
    "a14_histogram",
    """WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 20)) + 1, 20) AS INTEGER) AS bin,
          lo, hi FROM events, r)
    SELECT bin, round(lo + (bin - 1) * (hi - lo) / 20, 6) AS bin_from,
           round(lo + bin * (hi - lo) / 20, 6) AS bin_to, count(*) AS n_rows
    FROM b GROUP BY bin, lo, hi""",
)
def _(t):
    return rounded(aggregates.histogram(t.events, "value"))


@query(
    "a14_topic_ratio_histogram",
    f"""WITH {CORPUS}, {SUMMARY}, r AS (SELECT min(fake_ratio) AS lo, max(fake_ratio) AS hi FROM s),
    b AS (SELECT CAST(least(floor((fake_ratio - lo) / ((hi - lo) / 20)) + 1, 20) AS INTEGER) AS bin
          FROM s, r)
    SELECT bin, count(*) AS n_rows FROM b GROUP BY bin""",
)
def _(t):
    topics = aggregates.topic_label_summary(t.corpus)
    return aggregates.histogram(topics, "fake_ratio").select("bin", "n_rows")


@query(
    "a15_box_stats",
    """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1,
      quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3
      FROM events GROUP BY event_type)
    SELECT q.event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
      round(min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
      round(max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
      count(*) FILTER (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)) AS n_outliers
    FROM events e JOIN q ON e.event_type = q.event_type GROUP BY q.event_type, q1, median, q3""",
)
def _(t):
    return rounded(aggregates.box_stats(t.events, "value", "event_type"))


@query(
    "a16_group_size",
    f"""WITH {CORPUS} SELECT row_id, is_bs, count(text) OVER (PARTITION BY is_bs) AS group_size
    FROM corpus""",
)
def _(t):
    return aggregates.group_size_on_rows(t.corpus.select("row_id", "is_bs", "text")).drop("text")


@query(
    "w01_keep_first",
    "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text",
)
def _(t):
    return windows.keep_first(t.documents.select("doc_id", "text"), "text", "doc_id")


@query(
    "w02_first_n",
    """SELECT doc_id, source FROM documents
    QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7""",
)
def _(t):
    return windows.first_n(t.documents.select("doc_id", "source"), "source", 7, "doc_id")


@query(
    "w03_top_k_per_class",
    f"""WITH {CORPUS},
    e AS (SELECT is_bs, unnest({S.entity_list('text')}) AS x FROM corpus),
    c AS (SELECT is_bs, x.word AS entity, count(*) AS n FROM e WHERE x.g = 'MISC' GROUP BY is_bs, x.word
          QUALIFY row_number() OVER (PARTITION BY is_bs ORDER BY count(*) DESC, x.word) <= 10)
    SELECT entity, coalesce(max(n) FILTER (is_bs = 1), 0) AS n_label_1,
           coalesce(max(n) FILTER (is_bs = 0), 0) AS n_label_0 FROM c GROUP BY entity""",
    heavy=True,
)
def _(t):
    tagged = ent.extract_entities(t.corpus, S.GAZETTEER)
    return windows.top_k_per_class(ent.explode_entities(tagged), "MISC", 10)


_WEIGHTS = r"""w AS (SELECT term, CAST(count(*) AS DOUBLE) / length(term) AS weight
    FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents)
    GROUP BY term)"""


@query(
    "w04_extremes",
    f"""WITH {_WEIGHTS}
    (SELECT 'top' AS side, term, round(weight, 6) AS weight FROM w
     ORDER BY w.weight DESC, term LIMIT 30)
    UNION ALL (SELECT 'bottom', term, round(weight, 6) FROM w ORDER BY w.weight, term LIMIT 30)""",
    heavy=True,
)
def _(t):
    weights = (
        t.documents.select(F.explode(lexical.letter_runs(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg((F.count("*") / F.char_length("term")).alias("weight"))
    )
    top, bottom = windows.extremes(weights)
    both = top.withColumn("side", F.lit("top")).unionByName(
        bottom.withColumn("side", F.lit("bottom"))
    )
    return rounded(both)


@query(
    "w05_head_by_ratio",
    f"""WITH {CORPUS}, {SUMMARY} SELECT topic, n_label_0, n_label_1, total,
    round(fake_ratio, 6) AS fake_ratio FROM s ORDER BY s.fake_ratio DESC, topic LIMIT 10""",
)
def _(t):
    return rounded(
        windows.head_by(aggregates.topic_label_summary(t.corpus), "fake_ratio", "topic", 10)
    )


@query(
    "w06_shuffled",
    f"""SELECT doc_id, row_number() OVER (ORDER BY {S.ranked('doc_id')}) - 1 AS shuffle_pos
    FROM documents""",
)
def _(t):
    return windows.shuffled(t.documents.select("doc_id"), "doc_id")


@query(
    "w07_best_score",
    """WITH s AS (SELECT doc_id, n_chars % 7 AS a, length(text) % 5 AS b, doc_id % 6 AS c
             FROM documents)
    SELECT doc_id, CASE WHEN a >= b AND a >= c THEN 'a' WHEN b >= c THEN 'b' ELSE 'c' END AS label,
           CAST(greatest(a, b, c) AS DOUBLE) AS score FROM s""",
)
def _(t):
    values = {
        "a": F.col("n_chars") % 7,
        "b": F.char_length("text") % 5,
        "c": F.col("doc_id") % 6,
    }
    listed = F.array(
        *[
            F.struct(F.lit(k).alias("label"), v.cast("double").alias("score"))
            for k, v in values.items()
        ]
    )
    return t.documents.withColumn("best", scores.best_score(listed)).select(
        "doc_id", "best.label", "best.score"
    )


@query("w08_preview", "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 5")
def _(t):
    return windows.preview(filters.keep(t.documents, "doc_id", "lang"), 5, "doc_id")
