"""The pages as a stream, drained with ``availableNow``."""

from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.session import ROCKSDB_PROVIDER, work_path
from corpusloom.sources import files
from corpusloom.streaming import sample as st
from corpusloom.suite import sqlparts as S
from corpusloom.suite.filter_queries import BS_HOSTS, LABEL_CASE, LEGIT_HOSTS
from corpusloom.suite.registry import query

HOSTS = sorted({*BS_HOSTS, *LEGIT_HOSTS})
_HOSTS_SQL = ", ".join(f"'{h}'" for h in HOSTS)
N = 3


def _stream(t, table: str = "pages"):
    rows = getattr(t, table)
    # a table is one file, or a folder of files
    parents = {name.rsplit("/", 2)[-2] for name in rows.inputFiles()}
    if f"{table}.parquet" in parents:
        return files.read_stream(t.spark, f"{t.folder}/{table}.parquet", rows.schema)
    return files.read_stream(t.spark, t.folder, rows.schema, pattern=f"{table}.parquet")


def _drain(t, stream):
    path, checkpoint = work_path(t.spark, "sink"), work_path(t.spark, "offsets")
    query_ = st.start_to_parquet(stream, path, checkpoint)
    query_.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path), query_


def _rocksdb(t):
    t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


@query("s07_stream_source", "SELECT doc_id, lang FROM documents")
def _(t):
    return _drain(t, _stream(t, "documents").select("doc_id", "lang"))[0]


@query(
    "t01_stream_host_filter",
    f"SELECT page_id, {S.host('url')} AS host FROM pages WHERE {S.host('url')} IN ({_HOSTS_SQL})",
)
def _(t):
    return _drain(t, st.filter_hosts(_stream(t), HOSTS).select("page_id", "host"))[0]


CAPPED = f"""cap AS (SELECT page_id, url, {S.host('url')} AS host FROM pages
    WHERE {S.host('url')} IN ({_HOSTS_SQL})
    QUALIFY row_number() OVER (PARTITION BY {S.host('url')} ORDER BY page_id) <= {N})"""


@query("t02_capped_sample", f"WITH {CAPPED} SELECT page_id, url, host FROM cap")
def _(t):
    _rocksdb(t)
    path, checkpoint = work_path(t.spark, "sample"), work_path(t.spark, "sample-state")
    return st.collect_until_full(_stream(t), HOSTS, N, path, checkpoint).drop("html")


@query(
    "t03_stream_labels", f"SELECT page_id, CAST({LABEL_CASE} AS INTEGER) AS is_bs FROM pages"
)
def _(t):
    return _drain(t, st.label_stream(_stream(t), BS_HOSTS, LEGIT_HOSTS).select("page_id", "is_bs"))[0]


@query(
    "t04_progress_counts",
    f"""WITH {CAPPED} SELECT h.host, count(c.page_id) AS n_rows
    FROM (VALUES {', '.join(f"('{h}')" for h in [*HOSTS, 'never.example.com'])}) AS h(host)
    LEFT JOIN cap c ON c.host = h.host GROUP BY h.host""",
)
def _(t):
    _rocksdb(t)
    path, checkpoint = work_path(t.spark, "counted"), work_path(t.spark, "counted-state")
    wanted = [*HOSTS, "never.example.com"]
    st.collect_until_full(_stream(t), wanted, N, path, checkpoint, progress=f"{path}-counts")
    return st.progress_counts(t.spark, f"{path}-counts", wanted)


def _several_batches(t, n: int):
    """The pages as a stream of ``n`` micro-batches."""
    folder = work_path(t.spark, "page-files")
    t.pages.select("page_id", "url").repartition(n).write.parquet(folder)
    pages = files.read_stream(t.spark, folder, t.pages.select("page_id", "url").schema)
    return pages.withColumn("host", urls.url_host(F.col("url")))


BATCHES = 4


@query("t04_batches", f"SELECT CAST({BATCHES} AS BIGINT) AS n_batches, count(*) AS n_seen FROM pages")
def _(t):
    path, progress = work_path(t.spark, "rows"), work_path(t.spark, "progress")
    st.start_with_progress(_several_batches(t, BATCHES), path, progress, work_path(t.spark, "offsets")).awaitTermination()
    table = st.progress_table(t.spark, progress)
    return table.agg(F.count("*").alias("n_batches"), F.max("n_seen").alias("n_seen"))


@query(
    "t04_seen_by_host",
    f"SELECT {S.host('url')} AS host, count(*) AS n_rows FROM pages GROUP BY {S.host('url')}",
)
def _(t):
    path, progress = work_path(t.spark, "rows"), work_path(t.spark, "progress")
    st.start_with_progress(_several_batches(t, BATCHES), path, progress, work_path(t.spark, "offsets")).awaitTermination()
    return st.batch_counts(t.spark, progress).groupBy("host").agg(F.sum("n_rows").alias("n_rows"))


@query(
    "t02_capped_sample_by_batches",
    f"""SELECT {S.host('url')} AS host, least(count(*), {N}) AS n_rows FROM pages
    WHERE {S.host('url')} IN ({_HOSTS_SQL}) GROUP BY {S.host('url')}""",
)
def _(t):
    _rocksdb(t)
    path, checkpoint = work_path(t.spark, "sample"), work_path(t.spark, "sample-state")
    found = st.collect_until_full(_several_batches(t, BATCHES), HOSTS, N, path, checkpoint)
    return found.groupBy("host").agg(F.count("*").alias("n_rows"))
