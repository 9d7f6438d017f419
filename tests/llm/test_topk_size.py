"""Joins of the vector search whose size Spark can't know beforehand."""

import numpy as np

from fathom.llm.topk import top_k


def test_query_blocks_are_never_broadcast(spark, monkeypatch):
    from fathom.llm import topk

    monkeypatch.setattr(topk, "VECTOR_BLOCK", 100)
    x = np.random.default_rng(5).integers(-200, 200, (3000, 64))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<double>")
    # 60 queries are sent to 30 blocks: 30 times what Spark takes their size for
    monkeypatch.setattr(topk, "WIDEST_BLOCK", 100, raising=False)
    spark.conf.set("spark.sql.maxBroadcastTableSize", "200k")
    try:
        got = sorted(map(tuple, top_k(df, df.where("vec_id % 50 = 0")).collect()))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    want = []
    for i in range(0, 3000, 50):
        best = sorted((-int(s), j) for j, s in enumerate(x @ x[i]) if j != i)[:5]
        want += [(i, r + 1, v, -s) for r, (s, v) in enumerate(best)]
    assert got == want


def test_narrow_kinds(spark):
    # the ends of each type that blocks are packed in
    ends = [1, -127, -128, 128, -(2**15), 2**15 - 1, 2**15, -(2**31), 2**31 - 1, 2**31, -(2**40)]
    for m in ends:
        df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [float(m), 1.0])], "vec_id long, v array<double>")
        assert [tuple(r) for r in top_k(df, df.where("vec_id = 1")).collect()] == [(1, 1, 0, m + 1)]
