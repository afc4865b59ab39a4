import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from planlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session("4", "tests", spark__sql__shuffle__partitions="2")
    yield s
    s.stop()


@pytest.fixture
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def shuffled(spark):
    """Rows a query writes into its exchanges."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def rows():
        it = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None).iterator()
        n = 0
        while it.hasNext():
            n += it.next().shuffleWriteRecords()
        return n

    def count(run):
        before = rows()
        run().write.format("noop").mode("overwrite").save()
        return rows() - before
    return count
