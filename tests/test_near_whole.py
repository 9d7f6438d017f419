"""near_dup_pairs does its whole job: pairs of any labels, at the threshold itself, and of vectors that SQL gives no similarity."""

import duckdb
import numpy as np
import pytest
from conftest import rows_of

import fathom.plans.catalog  # noqa: F401
from fathom.operators import curate as cu
from fathom.queries import ORACLES, QUERIES

HALVES = [1.0, 1.0, 0.0, 0.0, 0.0, 0.0], [3.0, 4.0, 13.0, 2.0, 1.0, 1.0]  # 7 / sqrt(2 * 200), which is 0.35


def written(spark, at, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return str(at)


def against_sql(spark, at):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{at}/embeddings.parquet/*.parquet'")
    got = QUERIES["near_dup_pairs"](spark, at).toPandas()
    assert rows_of(got) == rows_of(con.sql(ORACLES["near_dup_pairs"]).df())
    return {(int(a), int(b)) for a, b in zip(got.a, got.b)}


def test_pairs_of_any_labels(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(200, 16)).astype(np.float32)
    x[100:] = x[:100]
    label = lambda i: None if i % 7 == 0 else i % 7
    got = against_sql(spark, written(spark, tmp_path, [(i, v, label(i)) for i, v in enumerate(x.tolist())]))
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(u @ u.T >= 0.35, 1)))}
    assert got == want and {(i, i + 100) for i in range(100)} <= want and any(label(i) != label(j) for i, j in want)


def test_pairs_at_the_threshold(spark, tmp_path):
    scaled = [[c * k for c in v] for v in HALVES for k in (1, 2, 4, 8)]
    got = against_sql(spark, written(spark, tmp_path, [(i, v, 1) for i, v in enumerate(scaled)]))
    assert got == {(i, j) for i in range(8) for j in range(i + 1, 8)}


def test_pairs_without_similarity(spark, tmp_path):
    rows = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0] * 3, [0.0] * 3, [float("nan"), 0.0, 1.0], [float("inf"), 1.0, 1.0], None]
    got = against_sql(spark, written(spark, tmp_path, [(i, v, i) for i, v in enumerate(rows)]))
    assert got == {(i, j) for j in range(2, 6) for i in range(j)}
    (tmp_path / "none").mkdir()
    assert against_sql(spark, written(spark, tmp_path / "none", [(1, [], 1), (2, [], 1)])) == set()


@pytest.mark.parametrize("block", [7, 10**6])
def test_pairs_of_tiny_and_large_components(spark, block):
    rows = [(i, [c * s for c in v]) for i, (v, s) in enumerate((v, s) for v in HALVES for s in (1.0, 2.0**-600, 2.0**600))]
    got = {(r.a, r.b) for r in cu.similar_pairs(spark.createDataFrame(rows, "id long, v array<double>"), 0.35, "id", "v", block=block).collect()}
    assert got == {(i, j) for i in range(6) for j in range(i + 1, 6)}


def test_blocks_that_grow(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(500, 6))
    df = spark.createDataFrame(list(enumerate(x.tolist())), "id long, v array<double>")
    want = sorted((r.a, r.b) for r in cu.similar_pairs(df, 0.9, "id", "v").collect())
    monkeypatch.setattr(cu, "BLOCKS", 2)
    monkeypatch.setattr(cu, "SLICE", 1)
    monkeypatch.setattr(cu, "BLOCK", 64)
    monkeypatch.setattr(cu, "BATCH", 16)
    got = sorted((r.a, r.b) for r in cu.similar_pairs(df, 0.9, "id", "v", block=10).collect())
    assert got == want and len(want) > 300


def test_links_of_equal_vectors(spark):
    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [1e-200, 1e-200]), (3, [0.0, 0.0]), (4, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert {(r.a, r.b) for r in cu.similar_links(df, 1.0, "id", "v").collect()} == {(0, 1), (0, 2)}
    assert {(r.a, r.b) for r in cu.similar_pairs(df, 1.0, "id", "v").collect()} == {(0, 1), (0, 2), (1, 2)}
