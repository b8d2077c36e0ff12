"""Arrow batches in small parts, so that a Python worker and its executor hold little at once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

# Bytes of a part, going by the mean row of its batch.
PART_BYTES = 1 << 20
ROWS_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROWS = 500


def few_rows_at_once(spark: SparkSession, rows: int = ROWS) -> None:
    """Lets the session send at most ``rows`` rows at once to Python workers.

    A smaller number of its own stays.  Results do not depend on it.
    """
    now = int(spark.conf.get(ROWS_CONF))
    if now <= 0 or now > rows:
        spark.conf.set(ROWS_CONF, str(rows))


def parts(batches: Iterator[pa.RecordBatch], size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in their order, in parts of about ``size`` bytes, one row at least.

    An empty batch stays.  After each batch Arrow's pool gives back what it no longer
    uses: a worker outlives its task, and would keep that beside later stages.
    """
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(1, batch.nbytes))
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)
        del batch
        pa.default_memory_pool().release_unused()
