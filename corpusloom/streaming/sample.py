"""A capped sample per host from an unbounded corpus (survey T01-T04)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from corpusloom.functions import urls
from corpusloom.operators import filters, joins

HOST, BATCH = "host", "batch"


def filter_hosts(stream: DataFrame, hosts: Iterable[str], url_col: str = "url") -> DataFrame:
    """Rows whose host is listed, with the host as a column."""
    kept = filters.host_in(stream, list(hosts), url_col)
    return kept.withColumn(HOST, urls.url_host(F.col(url_col)))


def label_stream(
    stream: DataFrame, bs_hosts: Iterable[str], legit_hosts: Iterable[str], url_col: str = "url"
) -> DataFrame:
    """Labels by host on a streaming frame."""
    return joins.label_by_host(stream, bs_hosts, legit_hosts, url_col)


class FirstN(StatefulProcessor):
    """Lets the first ``n`` rows of a key pass, over the whole life of the query."""

    def __init__(self, n: int, order_col: str, columns: list[str]):
        self.n, self.order_col, self.columns = n, order_col, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.taken = handle.getValueState("taken", "n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        taken = self.taken.get()[0] if self.taken.exists() else 0
        room = self.n - taken
        if room <= 0:
            return
        best = None
        for frame in rows:
            both = frame if best is None else pd.concat([best, frame])
            best = both.nsmallest(room, self.order_col, keep="first")
        if best is not None and len(best):
            self.taken.update((taken + len(best),))
            yield best[self.columns]

    def close(self) -> None:
        pass


def _cap_in_task(n: int, key: str, order_col: str, columns: list[str]):
    """Keep at most ``n`` rows per key of a task's rows, the first in order.

    Whatever the whole batch would take from a key is among them, so a key that
    holds most of the stream reaches its state as a few rows per task.
    """

    def cap(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for frame in frames:
            both = frame if best is None else pd.concat([best, frame])
            best = both.sort_values(order_col, kind="stable").groupby(key, sort=False).head(n)
        if best is not None:
            yield best[columns]

    return cap


def capped_sample(
    stream: DataFrame, n: int = 10, key: str = HOST, order_col: str = "page_id"
) -> DataFrame:
    """The first ``n`` rows per key; the count survives restarts.

    The keys must come from a bounded list (see ``filter_hosts``), as each task
    holds ``n`` rows per key.
    """
    columns = stream.columns
    capped = stream.mapInPandas(_cap_in_task(n, key, order_col, columns), stream.schema)
    return capped.groupBy(key).transformWithStateInPandas(
        statefulProcessor=FirstN(n, order_col, columns),
        outputStructType=T.StructType(stream.schema.fields),
        outputMode="Append",
        timeMode="None",
    )


def start_to_parquet(
    sample: DataFrame, path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Start a query that appends to a Parquet table, exactly once."""
    writer = (
        sample.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_with_progress(
    stream: DataFrame,
    path: str,
    progress: str,
    checkpoint: str,
    key: str = HOST,
    available_now: bool = True,
) -> StreamingQuery:
    """Append a stream to a table, and the rows of each key in each micro-batch to another.

    Both have a folder for each batch, named by its number and written over when a
    batch is tried again, so a lost driver or executor leaves neither gaps nor
    doubles, and the counts of all batches stay, over restarts as well.  Counts are
    taken from the rows as they were written.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = f"{path}/{BATCH}={number}"
        batch.write.mode("overwrite").parquet(rows)
        written = batch.sparkSession.read.schema(batch.schema).parquet(rows)
        counts = written.groupBy(key).agg(F.count("*").alias("n_rows"))
        counts.coalesce(1).write.mode("overwrite").parquet(f"{progress}/{BATCH}={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def collected(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows that a stream has appended by batches."""
    return _by_batch(spark, path, schema).drop(BATCH)


def _by_batch(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table with a folder for each batch; empty as long as there is none."""
    whole = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
    try:
        return spark.read.schema(whole).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], whole)


def batch_counts(spark: SparkSession, progress: str, key: str = HOST) -> DataFrame:
    """``(batch, <key>, n_rows)`` of every batch that had rows."""
    return _by_batch(spark, progress, T.StructType().add(key, "string").add("n_rows", "long"))


def progress_table(spark: SparkSession, progress: str, key: str = HOST) -> DataFrame:
    """``(batch, n_rows, n_seen)`` of every batch that had rows; ``n_seen`` adds up to it."""
    by_batch = batch_counts(spark, progress, key).groupBy(BATCH).agg(F.sum("n_rows").alias("n_rows"))
    until = Window.orderBy(BATCH).rowsBetween(Window.unboundedPreceding, 0)
    return by_batch.withColumn("n_seen", F.sum("n_rows").over(until))


def progress_counts(spark: SparkSession, progress: str, hosts: Iterable[str]) -> DataFrame:
    """Rows collected so far per listed host, 0 for none; reads the counts only."""
    listed = urls.normalise_hosts(hosts)
    table = spark.createDataFrame([(h,) for h in listed], f"{HOST} string")
    found = batch_counts(spark, progress).groupBy(HOST).agg(F.sum("n_rows").alias("n_rows"))
    return table.join(found, HOST, "left").select(
        HOST, F.coalesce("n_rows", F.lit(0)).alias("n_rows")
    )


def collect_until_full(
    stream: DataFrame,
    hosts: Iterable[str],
    n: int,
    path: str,
    checkpoint: str,
    order_col: str = "page_id",
    url_col: str = "url",
    poll_seconds: float = 1.0,
    available_now: bool = True,
    progress: str | None = None,
) -> DataFrame:
    """T01 + T02 + early stop: ends with the input or once every host has ``n`` rows.

    Only one count per listed host comes to the driver.  Counts by batch are below
    ``progress``, next to ``path`` if that is not given.
    """
    spark = stream.sparkSession
    listed = urls.normalise_hosts(hosts)
    sample = capped_sample(filter_hosts(stream, listed, url_col), n, HOST, order_col)
    progress = progress or f"{path.rstrip('/')}-progress"
    query = start_with_progress(sample, path, progress, checkpoint, HOST, available_now)
    seen = -1
    while not query.awaitTermination(poll_seconds):
        last = query.lastProgress
        if last is None or last["batchId"] == seen:
            continue
        seen = last["batchId"]
        counts = progress_counts(spark, progress, listed)
        if counts.filter(F.col("n_rows") < n).isEmpty():
            query.stop()
            break
    return collected(spark, path, sample.schema)
