"""G01-G04."""

from pyspark.sql import functions as F

from corpusloom.functions import keys
from corpusloom.operators import sampling, windows
from corpusloom.session import materialise
from corpusloom.suite import sqlparts as S
from corpusloom.suite.registry import CORPUS, query


@query(
    "g01_topic_parity",
    f"""WITH {CORPUS} SELECT row_id, topic FROM corpus
    QUALIFY count(*) OVER (PARTITION BY topic) >= 20""",
)
def _(t):
    return sampling.topic_parity(t.corpus, 20).select("row_id", "topic")


def balanced_sql(source: str, key: str, n: int, name: str = "bal") -> str:
    """CTE with the balanced sample of ``source``."""
    return f"""{name} AS (SELECT * FROM {source} QUALIFY
      row_number() OVER (PARTITION BY {key} ORDER BY {S.ranked()}) <= least(
        {n} // (SELECT count(DISTINCT {key}) FROM {source}),
        (SELECT min(c) FROM (SELECT count(*) AS c FROM {source} GROUP BY {key}))))"""


@query(
    "g02_balanced_sample",
    f"""WITH {CORPUS}, {balanced_sql('corpus', 'is_bs', 100)}
    SELECT row_id, is_bs, row_number() OVER (ORDER BY {S.ranked()}) - 1 AS shuffle_pos FROM bal""",
)
def _(t):
    sample = sampling.balanced_sample(t.corpus, ["is_bs"], 100).select("row_id", "is_bs")
    return windows.shuffled(sample)


_PAIR = "is_bs || '__' || toxic"


@query(
    "g02_balanced_sample_two_columns",
    f"""WITH {CORPUS}, {balanced_sql('corpus', _PAIR, 1000)}
    SELECT row_id, {_PAIR} AS stratum FROM bal""",
)
def _(t):
    sample = sampling.balanced_sample(t.corpus, ["is_bs", "toxic"], 1000)
    return sample.select("row_id", keys.composite_key("is_bs", "toxic").alias("stratum"))


def split_sql(source: str, key: str, ratio: str, name: str = "sp") -> str:
    """CTE with every row of ``source`` and its side."""
    return f"""{name}_n AS (SELECT CAST({key} AS VARCHAR) AS k, count(*) AS n FROM {source} GROUP BY 1),
    {name}_f AS (SELECT k, n, CAST(floor({ratio} * n) AS BIGINT) AS base,
        {ratio} * n - floor({ratio} * n) AS part FROM {name}_n),
    {name}_q AS (SELECT k, base + CASE WHEN row_number() OVER (ORDER BY part DESC, k)
        <= (SELECT ceil({ratio} * sum(n)) - sum(base) FROM {name}_f) THEN 1 ELSE 0 END AS quota
        FROM {name}_f),
    {name} AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY {key} ORDER BY {S.ranked()})
        <= q.quota THEN 'test' ELSE 'train' END AS split
        FROM {source} s JOIN {name}_q q ON CAST({key} AS VARCHAR) = q.k)"""


@query(
    "g03_stratified_split",
    f"WITH {CORPUS}, {split_sql('corpus', 'topic', '0.1')} SELECT row_id, topic, split FROM sp",
)
def _(t):
    return sampling.stratified_split(t.corpus, 0.9, 0.1, ["topic"]).select(
        "row_id", "topic", "split"
    )


@query(
    "g03_plain_split",
    "WITH d AS (SELECT doc_id AS row_id FROM documents), "
    f"{split_sql('d', chr(39) + 'all' + chr(39), '0.2')} SELECT row_id, split FROM sp",
)
def _(t):
    docs = t.documents.select(F.col("doc_id").alias("row_id"))
    return sampling.stratified_split(docs, 0.8, 0.2)


@query(
    "g04_train_only",
    f"""WITH {CORPUS}, {split_sql('corpus', 'is_bs', '0.1')}
    SELECT row_id, split, CASE WHEN split = 'train' THEN lower(text) ELSE text END AS text FROM sp""",
)
def _(t):
    split = sampling.stratified_split(
        t.corpus.select("row_id", "text", "is_bs"), 0.9, 0.1, ["is_bs"]
    )
    split = materialise(split, "g04", ["split"])
    train, test = sampling.train_only(split, lambda d: d.withColumn("text", F.lower("text")))
    return (
        train.withColumn("split", F.lit("train"))
        .unionByName(test.withColumn("split", F.lit("test")))
        .select("row_id", "split", "text")
    )
