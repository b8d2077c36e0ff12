import pytest

from corpusloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("8", "corpusloom-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Evaluate expressions over a list of values: ``one(values, fn)``."""
    from pyspark.sql import functions as F

    def run(values, fn, kind="string"):
        rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
        return [r["y"] for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]

    return run
