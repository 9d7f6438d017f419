"""Near duplicates whose rows come in another order whenever they are read, as shuffles of a cluster give them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import curate as cu


def unordered(df):
    def run(frames):
        import numpy as np

        for pdf in frames:
            yield pdf.iloc[np.random.permutation(len(pdf))]

    return df.mapInPandas(run, df.schema)


@pytest.fixture
def twins(spark):
    """Rows 2 i and 2 i + 1 are near duplicates."""
    x = np.random.default_rng(1).normal(size=(150, 32))
    rows = [(2 * i + k, [float(c) for c in v + 0.001 * k]) for i, v in enumerate(x) for k in (0, 1)]
    spark.conf.set("spark.sql.exchange.reuse", "false")
    yield spark.createDataFrame(rows, "id long, v array<double>").coalesce(1)
    spark.conf.unset("spark.sql.exchange.reuse")


def test_pairs_of_a_block_in_any_order(twins):
    got = sorted((r.a, r.b) for r in cu.similar_pairs(unordered(twins), 0.999, "id", "v", block=100).collect())
    assert got == [(i, i + 1) for i in range(0, 300, 2)]


def test_groups_in_any_order(twins, monkeypatch):
    # equal vectors are staged before they are compared
    monkeypatch.setattr(cu, "stage", lambda df, tag: unordered(df.coalesce(1)))
    got = cu.representatives(twins, cu.similar_links(twins, 0.999, "id", "v"), "id", [F.desc("id")]).collect()
    assert sorted(map(tuple, got)) == [(i, i - i % 2, i % 2 == 1) for i in range(300)]
