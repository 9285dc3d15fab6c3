import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pageloom.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, partitions=4)


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of a Column rule over rows of Python values, in order."""
    from pyspark.sql import functions as F

    def run(rule, rows, schema):
        table = spark.createDataFrame(
            [(i, *row) for i, row in enumerate(rows)], f"_i int, {schema}"
        )
        names = [c for c in table.columns if c != "_i"]
        found = table.select("_i", rule(*[F.col(n) for n in names]).alias("v")).collect()
        return [r.v for r in sorted(found, key=lambda r: r._i)]

    return run
