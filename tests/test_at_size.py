"""Queries against their SQL on tables so large that Spark samples the bounds of ranges."""

import duckdb
import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_near_order import unordered

import fathom.plans.catalog  # noqa: F401
from fathom.operators import curate as cu
from fathom.queries import ORACLES, QUERIES

N = 60000


@pytest.fixture(scope="module")
def big(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("big"))
    i = F.col("id")
    d = spark.range(N).select((i * 7919 % N).alias("doc_id"), F.sha2(i.cast("string"), 256).alias("text"), F.when(i % 7 > 0, F.concat(F.lit("l"), i % 4)).alias("lang"), (50 + i % 150).alias("n_chars"))
    d.write.parquet(f"{at}/documents.parquet")
    return at


def against_sql(spark, at, name):
    got, con = QUERIES[name](spark, at).toPandas(), duckdb.connect()
    for t in ("documents", "embeddings"):
        if t in ORACLES[name]:
            con.sql(f"create view {t} as select * from '{at}/{t}.parquet/*.parquet'")
    want = con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(want) > 0
    assert rows_of(got) == rows_of(want)


def test_collated_batches(spark, big):
    against_sql(spark, big, "collated_batches")


def test_training_dataset(spark, big):
    against_sql(spark, big, "training_dataset")


def test_tar_shards(spark, big):
    against_sql(spark, big, "tar_shards")


def test_near_dup_groups(spark, tmp_path, monkeypatch):
    # rows 2 i and 2 i + 1 are near duplicates; what is staged comes in another order whenever it is read
    x = np.random.default_rng(2).normal(size=(80, 64))
    rows = [(2 * i + k, i % 2, [float(c) for c in v + 0.001 * k]) for i, v in enumerate(x) for k in (0, 1)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(cu, "stage", lambda df, tag: unordered(df.coalesce(1)))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        against_sql(spark, str(tmp_path), "near_dup_groups")
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
