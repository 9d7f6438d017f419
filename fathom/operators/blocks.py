"""Exact nearest rows of many queries at once: blocks of queries meet blocks of vectors as matrices, no pairs of rows are made by a join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors and queries in a block, about: bounds a task's memory.
VECTORS, QUERIES = 8192, 256


def _packed(df: DataFrame, by: list[str]) -> DataFrame:
    """(*by, dim, ids, mat) of each group of (id, v) rows."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        flat = np.asarray(t.column("v").combine_chunks().flatten(), np.float64)
        return pa.table({**{c: t.column(c)[:1] for c in (*by, "dim")}, "ids": pa.array([np.asarray(t.column("id"), np.int64).tobytes()], pa.binary()), "mat": pa.array([flat.tobytes()], pa.binary())})

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*by, "dim"))
    return df.groupBy(*by, "dim").applyInArrow(run, f"{kinds}, ids binary, mat binary")


def distances(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """Of one query to each row: L2, or 1 - cosine (1 where a length is 0)."""
    if metric == "l2":
        return np.sqrt(((x - q) ** 2).sum(axis=1))
    n = np.sqrt((x**2).sum(axis=1)) * np.sqrt((q**2).sum())
    return 1 - np.divide(x @ q, n, out=np.zeros(len(x)), where=n > 0)


def top_each(vectors: DataFrame, queries: DataFrame, k: int, key: str, column: str, metric: str = "l2", digits: int = 9, cell: str | None = None, query_cells: str | None = None) -> DataFrame:
    """(query, rank, key, distance): of each query the k nearest vectors other than its own row, ties (at `digits` digits) to the smaller key.

    cell and query_cells limit a query to vectors of its cells (a column and an array column). Null vectors and ones of another length take no part."""
    v = vectors.where(F.col(column).isNotNull() & F.col(key).isNotNull())
    v = v.select((F.col(cell) if cell else F.lit(0)).cast("int").alias("cell"), F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).withColumn("dim", F.size("v"))
    sizes = v.groupBy("cell", "dim").agg(F.ceil(F.count("*") / VECTORS).cast("int").alias("blocks"))
    v = v.join(F.broadcast(sizes) if not cell else sizes, ["cell", "dim"]).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")).drop("blocks")
    q = queries.where(F.col(column).isNotNull() & F.col(key).isNotNull())
    q = q.select((F.explode(F.col(query_cells).cast("array<int>")) if query_cells else F.lit(0)).alias("cell"), F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).withColumn("dim", F.size("v"))
    n = max(1, -(-queries.count() // QUERIES))
    asks = _packed(q.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)).cast("int")), ["cell", "part"])
    asks = asks.join(sizes, ["cell", "dim"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("cell", "dim", "block", F.col("ids").alias("qids"), F.col("mat").alias("qmat"))
    met = _packed(v, ["cell", "block"]).join(asks, ["cell", "dim", "block"]).select("dim", "ids", "mat", "qids", "qmat")

    def run(batches):
        for batch in batches:
            for dim, ids, mat, qids, qmat in zip(*batch.columns):
                ids, qids = (np.frombuffer(b.as_py(), np.int64) for b in (ids, qids))
                x, y = (np.frombuffer(b.as_py(), np.float64).reshape(-1, dim.as_py()) for b in (mat, qmat))
                out = []
                for i, row in zip(qids, y):
                    d = np.round(distances(row, x, metric), digits)
                    d[ids == i] = np.inf
                    some = np.argpartition(d, min(k, len(d) - 1))[: k + 1] if len(d) > k else np.arange(len(d))
                    some = np.flatnonzero(d <= d[some].max()) if len(d) > k else some  # with all that tie with the last
                    best = some[np.lexsort((ids[some], d[some]))][:k]
                    best = best[np.isfinite(d[best])]
                    out.append((np.full(len(best), i), ids[best], d[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["query", key, "distance"])

    found = met.mapInArrow(run, f"query long, {key} long, distance double")
    w = Window.partitionBy("query").orderBy("distance", key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", key, "distance")
