import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from textfix.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "textfix-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def apply(spark):
    """Evaluate a function of Columns on rows of strings."""
    from pyspark.sql import functions as F

    def run(fn, rows, schema="a string"):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        indexed = [(i, *r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(indexed, f"_i int, {schema}").repartition(3)
        cols = [F.col(c) for c in df.columns[1:]]
        out = df.select("_i", fn(*cols).alias("out")).orderBy("_i").collect()
        return [plain(r["out"]) for r in out]

    def plain(value):
        if isinstance(value, list):
            return [plain(v) for v in value]
        return tuple(plain(v) for v in value) if isinstance(value, tuple) else value

    return run
