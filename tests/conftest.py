import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(x):
    """A value in a form that is alike in both engines."""
    import pandas as pd

    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if hasattr(x, "item") and not hasattr(x, "__len__"):
        x = x.item()
    if isinstance(x, float):
        return None if x != x else round(x, 6) if abs(x) < 1e15 else int(x)
    if isinstance(x, bool) or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, int):
        return x if abs(x) < 2**53 else int(float(x))
    return [plain(y) for y in x] if hasattr(x, "__len__") else x


def rows_of(pdf):
    return sorted((tuple(plain(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False)), key=repr)
