"""Search: full text by BM25, vectors exactly and by inverted lists, rank fusion, diversification."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as fn
from ..shared import stage
from .blocks import top_each


def hashed_vectors(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, v): unit-length signed token counts of a hashed bag of words, zeros for a text without tokens. The sum is local to a row: one pass, no shuffle."""
    rows = df.select(F.col(key), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("t"))

    def run(batches):
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            out = np.zeros((batch.num_rows, dim))
            for i, t in enumerate(batch.column(1)):
                for w, n in Counter(re.findall("[a-z0-9]+", t.as_py())).items():
                    if (at := known.get(w)) is None:
                        h = hashlib.sha1(w.encode()).digest()
                        at = int.from_bytes(h[:4], "big") % dim, 1 - 2 * (h[4] & 1)
                        if len(known) < 100_000:
                            known[w] = at
                    out[i, at[0]] += at[1] * n
            length = np.sqrt((out**2).sum(axis=1, keepdims=True))
            out = np.divide(out, length, out=np.zeros_like(out), where=length > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim), pa.int32()), pa.array(out.ravel()))], names=[key, "v"])

    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("v", T.ArrayType(T.DoubleType()))]))


def hashed_embedding(df: DataFrame, key: str, text: str, dim: int) -> DataFrame:
    """(key, bucket, x): the non-zero entries of hashed_vectors."""
    return hashed_vectors(df, key, text, dim).select(key, F.posexplode("v").alias("bucket", "x")).where("x <> 0").select(key, F.col("bucket").cast("long").alias("bucket"), "x")


def hashed_query(spark: SparkSession, query: str, dim: int) -> list[float]:
    """The hashed vector of a query's text."""
    return list(hashed_vectors(spark.createDataFrame([(0, query)], "id int, t string"), "id", "t", dim).first().v)


class SearchError(ValueError):
    pass


def query_terms(query: str) -> list[str]:
    terms = sorted(set(re.findall(r"[a-z0-9]+", (query or "").lower())))
    if not terms:
        raise SearchError("the query has no word")
    return terms


def _scored(hits: DataFrame, stats: DataFrame, key: str, k1: float, b: float) -> DataFrame:
    """BM25 of (key, len, w, tf) hits under one-row stats (n, av)."""
    df_ = hits.groupBy("w").agg(F.count("*").alias("df"))  # at most one row for each query word
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("av")))
    return hits.join(F.broadcast(df_), "w").crossJoin(F.broadcast(stats)).groupBy(key).agg(F.sum(part).alias("score"))


class TextIndex:
    """Postings staged by a hash of the word, with document lengths and the version of what was indexed.

    A query reads the parts of its words only, whatever the corpus; search() refuses an index of another version."""

    PARTS = 64

    def __init__(self, df: DataFrame, key: str, text: str, version: str | int = 0):
        self.key, self.version = key, version
        words = df.select(key, fn.tokens(F.col(text)).alias("ws"))
        self.stats = stage(words.agg(F.count("*").alias("n"), F.avg(F.size("ws")).alias("av")), "index_stats")
        rows = words.select(key, F.size("ws").alias("len"), F.explode("ws").alias("w")).groupBy(key, "len", "w").agg(F.count("*").alias("tf"))
        self.postings = stage(rows.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(self.PARTS)).cast("int")), "postings", ["part"])

    def stale(self, version: str | int) -> bool:
        return version != self.version

    def bm25(self, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(key, score) of the rows that hold a query word."""
        terms = query_terms(query)
        spark = self.postings.sparkSession
        parts = [r[0] for r in spark.createDataFrame([(t,) for t in terms], "w string").select(F.pmod(F.xxhash64("w"), F.lit(self.PARTS)).cast("int")).distinct().collect()]
        hits = self.postings.where(F.col("part").isin(parts) & F.col("w").isin(terms)).select(self.key, "len", "w", "tf")
        return _scored(hits, self.stats, self.key, k1, b)


def bm25(df: DataFrame, query: str, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score) of the rows that hold a query word, without an index; only the query's words leave the scan, but lengths count all rows."""
    terms = query_terms(query)
    words = df.select(key, fn.tokens(F.col(text)).alias("ws"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("ws")).alias("av"))
    hits = words.select(key, F.size("ws").alias("len"), F.explode(F.filter("ws", lambda w: w.isin(*terms))).alias("w")).groupBy(key, "len", "w").agg(F.count("*").alias("tf"))
    return _scored(hits, stats, key, k1, b)


def search(
    rows: DataFrame, mode: str, key: str, *, query: str | None = None, vector: Sequence[float] | None = None, where: Column | None = None, limit: int = 10, order: Sequence[str] = (), text: str = "text", embedding: str = "embedding",
    index: TextIndex | None = None, version: str | int | None = None, ann: IvfIndex | None = None, route: str = "auto", probes: int = 4, fetch: int = 64, diversify: float | None = None,
) -> DataFrame:
    """(key, rank and score or distance): one entry for scalar, text, vector and hybrid search; ties go to the smaller key.

    scalar: rows that pass `where`, in the given order. text: BM25, by an index if one is given, which must be of the version asked for.
    vector: the nearest vectors, exactly or (route ann, or auto where there is one) by inverted lists. hybrid: reciprocal ranks of the `fetch` best of both
    legs. The filter holds before ranking. diversify: rows too like one already taken (cosine) are passed over, over the whole ranking."""
    if mode not in ("scalar", "text", "vector", "hybrid"):
        raise SearchError(f"unknown mode {mode!r}")
    if route not in ("auto", "exact", "ann"):
        raise SearchError(f"unknown route {route!r}")
    if limit < 1:
        raise SearchError("the limit is at least 1")
    if mode in ("text", "hybrid"):
        query_terms(query or "")
        if index is not None and version is not None and index.stale(version):
            raise SearchError(f"the text index is of version {index.version}, the table of {version}: build it again")
    if mode in ("vector", "hybrid"):
        if embedding not in rows.columns:
            raise SearchError(f"there is no column {embedding!r}")
        if vector is None:
            raise SearchError("a vector search needs a vector")
        if route == "ann" and ann is None:
            raise SearchError("route ann needs an index")
    if rows.isEmpty():
        raise SearchError("the table is empty")
    some = rows if where is None else rows.where(where)

    def texts(n):
        found = index.bm25(query) if index is not None else bm25(rows, query, key, text)
        if where is not None:
            found = found.join(some.select(key), key, "left_semi")
        return found.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), key).limit(n)

    def vectors(n):
        if ann is not None and route != "exact":
            one = rows.sparkSession.createDataFrame([(-1, [float(x) for x in vector])], f"{key} long, {embedding} array<double>")
            found = ann.nearest(one, n if where is None else ann.size, probes).select(key, "distance")
            return (found if where is None else found.join(some.select(key), key, "left_semi")).orderBy("distance", key).limit(n)
        return nearest(some, vector, n, key, embedding).withColumn("distance", F.round("distance", 9))

    if mode == "scalar":
        return _ranked(some.select(key, *[c for c in order if c != key]).orderBy(*order, key).limit(limit), [*order, key])
    if mode == "vector" and diversify is not None:
        return diverse_nearest(some, vector, limit, diversify, key, embedding).select(key, (F.col("position") + 1).alias("rank"))
    if mode == "text":
        return _ranked(texts(limit), [F.desc("score"), key])
    if mode == "vector":
        return _ranked(vectors(limit), ["distance", key])
    fused = rrf([(texts(fetch), F.desc("score")), (vectors(fetch), F.col("distance"))], key).withColumn("score", F.round("score", 9))
    return _ranked(fused.orderBy(F.desc("score"), key).limit(limit), [F.desc("score"), key])


def _ranked(bounded: DataFrame, order: Sequence) -> DataFrame:
    """The rank of each row of a bounded result."""
    return bounded.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def nearest(df: DataFrame, vector: Sequence[float], k: int, key: str = "vec_id", column: str = "embedding", metric: str = "l2", where: Column | None = None) -> DataFrame:
    """(key, distance): the k nearest rows that pass the filter, ties by key, null vectors last."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    d = fn.l2_distance(F.col(column), q) if metric == "l2" else 1 - fn.cosine(F.col(column), q)
    rows = df if where is None else df.where(where)
    return rows.select(key, d.alias("distance")).orderBy(F.asc_nulls_last("distance"), key).limit(k)


#: The largest table of centroids that is sent to the executors, in bytes.
CENTROID_BYTES = 64 << 20


class IvfIndex:
    """Inverted lists: k-means on at most `sample` rows chosen by a hash, every row in the list of its nearest centroid, staged by list."""

    def __init__(self, df: DataFrame, key: str, column: str, lists: int = 32, sample: int = 20000, seed: int = 1):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.key, self.column = key, column
        rows = df.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(column).cast("array<double>").alias(column))
        some = rows.orderBy(F.xxhash64(key), key).limit(sample).select(array_to_vector(F.col(column)).alias("features"))
        self.centres = np.array([list(c) for c in KMeans(k=lists, seed=seed, maxIter=10).fit(some).clusterCenters()])
        if self.centres.nbytes > CENTROID_BYTES:
            raise SearchError(f"centroids of {self.centres.nbytes} bytes; {CENTROID_BYTES} at most")
        self.rows = stage(self._lists(rows, 1).withColumn("list", F.col("lists")[0]).drop("lists"), "ivf", ["list"])
        self.size = rows.count()

    def _lists(self, df: DataFrame, n: int) -> DataFrame:
        """The rows with their n nearest lists."""
        centres, at, n = self.centres, df.columns.index(self.column), min(n, len(self.centres))

        def run(batches):
            for batch in batches:
                v = batch.column(at)
                x = np.asarray(v.flatten(), float).reshape(batch.num_rows, -1)
                if batch.num_rows:
                    d = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :]
                    best = np.argsort(d, axis=1, kind="stable")[:, :n].astype(np.int32)
                else:
                    best = np.empty((0, n), np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(np.arange(0, best.size + 1, n), pa.int32()), pa.array(best.ravel()))], names=[*batch.schema.names, "lists"])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("lists", T.ArrayType(T.IntegerType()))]))

    def nearest(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query, rank, key, distance) by probing each query's nearest lists and ranking exactly there."""
        asks = queries.where(F.col(self.column).isNotNull()).select(F.col(self.key).cast("long").alias(self.key), F.col(self.column).cast("array<double>").alias(self.column))
        return top_each(self.rows, self._lists(asks, probes), k, self.key, self.column, cell="list", query_cells="lists")

    def probes_for(self, queries: DataFrame, k: int, recall_floor: float) -> tuple[int, float]:
        """The fewest probes, by doubling, whose recall over the queries reaches the floor against exact search, and that recall."""
        exact = stage(top_each(self.rows, queries, k, self.key, self.column), "exact")
        probes = 1
        while True:
            got = recall(exact, self.nearest(queries, k, probes), ["query", self.key]).first()
            if probes >= len(self.centres) or got["recall"] is None or got["recall"] >= recall_floor:
                return probes, got["recall"]
            probes = min(2 * probes, len(self.centres))


def rrf(legs: Sequence[tuple[DataFrame, Column]], key: str, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (candidates, order) legs, ranks from 1: (key, score). Legs are bounded candidate lists."""
    parts = None
    for df, order in legs:
        leg = df.select(key, (1 / (k + F.row_number().over(Window.orderBy(order, key)))).alias("s"))
        parts = leg if parts is None else parts.unionByName(leg)
    return parts.groupBy(key).agg(F.sum("s").alias("score"))


def diversify(ranked: DataFrame, limit: int, threshold: float, key: str, column: str, order: Sequence) -> DataFrame:
    """Walk down a bounded candidate list; a row too like one already taken is passed over; a null vector never is. (key, position)"""
    rows = ranked.withColumn("__p", F.row_number().over(Window.orderBy(*order))).select(F.struct("__p", F.col(key).alias("id"), F.col(column).cast("array<double>").alias("v")).alias("r"))
    listed = rows.agg(F.array_sort(F.collect_list("r")).alias("rs"))
    kind = f"array<struct<__p:int,id:{ranked.schema[key].dataType.simpleString()},v:array<double>>>"
    like = lambda a, b: fn.cosine(a["v"], b["v"]) >= threshold
    taken = F.aggregate("rs", F.array().cast(kind), lambda acc, r: F.when((F.size(acc) >= limit) | F.coalesce(F.exists(acc, lambda x: like(x, r)), F.lit(False)), acc).otherwise(F.concat(acc, F.array(r))))
    return listed.select(F.posexplode(taken).alias("position", "r")).select(F.col("r.id").alias(key), "position")


def diverse_nearest(df: DataFrame, vector: Sequence[float], limit: int, threshold: float, key: str, column: str) -> DataFrame:
    """(key, position): the walk of diversify over the whole table in order of distance, null vectors last.

    The next row taken is the first one behind the last that is like none taken: `limit` rounds, each a map over the rows and a map-side-combined minimum."""
    q, v = F.array(*[F.lit(float(x)) for x in vector]), F.col("v")
    d = F.round(fn.l2_distance(F.col(column), q), 9)
    rows = df.select(F.struct(d.isNull().alias("far"), F.coalesce(d, F.lit(0.0)).alias("d"), F.col(key).alias("id")).alias("at"), F.col(column).cast("array<double>").alias("v"))
    taken: list = []
    while len(taken) < limit:
        left = rows
        if taken:
            far, dist, last = taken[-1].at
            left = left.where(F.col("at") > F.struct(F.lit(far).alias("far"), F.lit(dist).alias("d"), F.lit(last).cast(df.schema[key].dataType).alias("id")))
        for t in taken:
            if t.v is not None:
                left = left.where(~F.coalesce(fn.cosine(v, F.array(*map(F.lit, t.v))) >= threshold, F.lit(False)))
        best = left.agg(F.min(F.struct("at", "v")).alias("b")).first().b
        if best is None:
            break
        taken.append(best)
    return df.sparkSession.createDataFrame([(t.at.id, i) for i, t in enumerate(taken)], f"{key} {df.schema[key].dataType.simpleString()}, position int")


def recall(exact: DataFrame, approx: DataFrame, on: Sequence[str]) -> DataFrame:
    return exact.select(*on).distinct().join(approx.select(*on, F.lit(1).alias("__h")).distinct(), list(on), "left").agg(F.count("*").alias("n"), F.count("__h").alias("found")).withColumn("recall", F.col("found") / F.col("n"))
