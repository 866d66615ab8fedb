import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


from docloom.session import get_spark  # noqa: E402

# Started before the test modules load: they build columns at import time.
SESSION = get_spark("docloom-tests", cores=8)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture()
def value(spark):
    """Evaluate one column over a one-row table of given columns."""
    from pyspark.sql import types as T

    names = {str: T.StringType(), int: T.LongType(), float: T.DoubleType()}

    def run(column, **inputs):
        schema = T.StructType([T.StructField(k, names[t]) for k, (t, _) in inputs.items()] or [T.StructField("x", T.LongType())])
        row = tuple(v for _, v in inputs.values()) or (1,)
        return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]

    return run
