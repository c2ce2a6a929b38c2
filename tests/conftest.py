import numbers
import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))

import duckdb  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows_of(frame):
    """Rows of a pandas frame as comparable tuples, columns by name."""

    def one(v):
        if v is None or type(v).__name__ == "NAType" or isinstance(v, float) and v != v:
            return None
        if isinstance(v, numbers.Number) and not isinstance(v, bool) and "bool" not in type(v).__name__:
            return round(float(v), 6) + 0.0
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        return v if isinstance(v, str) else getattr(v, "item", lambda: v)()

    names = sorted(frame.columns)
    return sorted(map(repr, ([one(v) for v in row] for row in frame[names].itertuples(index=False, name=None))))


def same(spark_frame, duck, sql):
    a, b = spark_frame.toPandas(), duck.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)
