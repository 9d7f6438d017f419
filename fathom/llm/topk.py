"""Exact top-k by inner product with MaxScore over integer vectors.

A query's terms are its non-zero components. A term's postings for a positive weight are the vectors with a positive
component there, for a negative weight those with a negative one: all that the term can add to a score. Its bound is the
weight's greatest contribution in a shard. With terms in order of their bounds, those whose bounds sum to no more than
the query's threshold (its k-th best score so far) are non-essential: a vector found in their postings alone can't
enter the top k.

A query traverses the essential postings and sums what they add. Vectors whose sum, with the bounds of the non-essential
terms, stays above the threshold are probed: what the essential terms take away (components of the other sign) first,
then the non-essential terms, those of the greatest bound first, as long as the vector stays competitive. The threshold
rises from one slice of a shard to the next. Shards' results are merged.

Vectors and queries are packed into blocks (matrices in rows, of the narrowest type that holds their numbers), and every query block meets every vector
block once: no pairs of rows are ever made by a join. Spark can't know how large the query blocks are that are sent to every vector block, so that join is never
a broadcast; blocks of vectors grow with the input, so that queries are sent less often. Results of a block are at most k rows a query. A tie goes to the smaller
vec_id: slices hold vectors in order of it, so a later one needs a score above the threshold.

On dense vectors nearly all postings are essential and each holds half the vectors, so the traversal costs about as much as
a whole product; the method pays where weights are uneven or vectors sparse. It is exact for any data.

Defined results: vectors that are null, empty or hold null, NaN or infinite components take no part, neither as
queries; vectors meet queries of their own dimension only; rows repeating a vec_id are candidates each (rows alike in all
are sent once, with their number), as a query the one with the greatest vector counts, and no row of the query's own vec_id is its candidate.
Fewer than k candidates: all. Sums are exact whatever the components (whole numbers of any size beyond 2^53); a score that a long can't hold
is ranked by its true value and shown as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import arrow_rows
from .common import col, stage

#: Vectors and queries in a block, about: bounds a task's memory. A block holds a BLOCKS-th of the vectors, within these bounds. STEP: vectors of a block between which the threshold rises.
VECTOR_BLOCK, WIDEST_BLOCK, BLOCKS, QUERY_BLOCK, STEP = 8192, 65536, 64, 512, 2048
#: The largest long, and more than any sum of products of two doubles.
LONG, BEYOND = 2**63 - 1, 1 << 2104


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component as double, of the vectors that take part; v holds whole numbers as doubles."""
    e = col(vector)
    sound = e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double") * scale) < float("inf")))
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)  # noqa: E731  beyond, doubles are whole
    return df.where(sound & col(vec_id).isNotNull()).select(col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: whole(x.cast("double") * scale)).alias("v"))


def packed(rows: DataFrame, blocks: int, tag: str) -> DataFrame:
    """(dim, block, ids, times, kind, mat): vectors dealt to blocks by a hash of the row, sorted by id, as matrices of the kind that numpy calls so; rows has times, how often a row occurs."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("vec_id")
        flat = np.asarray(t.column("v").combine_chunks().flatten(), np.float64)
        ids, times = (np.asarray(t.column(c), np.int64).tobytes() for c in ("vec_id", "times"))
        most = np.abs(flat).max()
        kind = "i1" if most < 2**7 else "i2" if most < 2**15 else "i4" if most < 2**31 else "f8"
        return pa.table({"dim": t.column("dim")[:1], "block": t.column("block")[:1], "ids": pa.array([ids], pa.binary()), "times": pa.array([times], pa.binary()), "kind": pa.array([kind]), "mat": pa.array([flat.astype(kind).tobytes()], pa.binary())})

    dealt = rows.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("vec_id", "v", F.lit(tag)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "times", "v")
    return dealt.groupBy("dim", "block").applyInArrow(run, "dim int, block int, ids binary, times binary, kind string, mat binary")


def exact_type(q: np.ndarray, x: np.ndarray):
    """The fastest type in which every partial sum of the products is exact: a float, or whole numbers of any size."""
    if not q.size or not x.size:
        return np.float32
    most = float(np.abs(q).max()) * float(np.abs(x).max()) * q.shape[1]
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def as_kind(m: np.ndarray, kind) -> np.ndarray:
    return m.astype(kind) if kind is not object else np.array([int(y) for y in m.ravel()], object).reshape(m.shape)


def postings(x: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray, float]]]:
    """Of each term, for negative and for positive weights: (vectors, their components, the greatest size of these)."""
    out = []
    for c in x.T:
        sides = []
        for own in (c < 0, c > 0):
            at = np.flatnonzero(own)
            sides.append((at, c[at], np.abs(c[at]).max() if len(at) else 0))
        out.append(sides)
    return out


def maxscore(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, times: np.ndarray | None = None, step: int = STEP) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(row of the query, vec_id, score): the top k of each query among vectors sorted by id, each there as often as times says."""
    kind = exact_type(q, x)
    q, x, times = as_kind(q, kind), as_kind(x, kind), np.ones(len(ids), np.int64) if times is None else times
    shards = [(at, x[at : at + step], ids[at : at + step], postings(x[at : at + step])) for at in range(0, len(x), step)]
    rows, vecs, scores = [], [], []
    for i, w in enumerate(q):
        terms = np.flatnonzero(w != 0)
        best_s, best_i = np.empty(0, kind), np.empty(0, np.int64)
        for at, part, pid, post in shards:
            limit = best_s[-1] if len(best_s) == k else None
            bound = np.array([abs(w[d]) * post[d][int(w[d] > 0)][2] for d in terms], kind)
            order = np.argsort(bound, kind="stable")
            spare = np.zeros(len(terms), bool)
            if limit is not None and len(terms):
                spare[order] = np.cumsum(bound[order]) <= limit
            essential, others = terms[~spare], order[spare[order]][::-1]
            rest = bound[spare].sum() if spare.any() else 0
            if limit is not None and not len(essential) and rest <= limit:
                continue
            adds = np.zeros(len(pid), kind)
            for d in essential:
                found, value, _ = post[d][int(w[d] > 0)]
                adds[found] += w[d] * value
            live = np.flatnonzero(pid != q_ids[i] if limit is None else (adds + rest > limit) & (pid != q_ids[i]))
            score = part[live][:, essential] @ w[essential] if len(essential) else np.zeros(len(live), kind)
            for a in range(0, len(others), 8):
                if limit is not None:
                    some = score + rest > limit
                    live, score = live[some], score[some]
                if not len(live):
                    break
                d = terms[others[a : a + 8]]
                score = score + part[live][:, d] @ w[d]
                rest = rest - bound[others[a : a + 8]].sum()
            if limit is not None:
                live, score = live[score > limit], score[score > limit]
            s, n = np.concatenate([best_s, score.repeat(np.minimum(times[at + live], k))]), np.concatenate([best_i, pid[live].repeat(np.minimum(times[at + live], k))])
            # earlier slices hold smaller ids, so a stable sort keeps ties in order of vec_id
            top = np.argsort(-s, kind="stable")[:k]
            best_s, best_i = s[top], n[top]
        rows += [i] * len(best_s)
        vecs += best_i.tolist()
        scores += [int(v) for v in best_s]
    return np.array(rows, np.int64), np.array(vecs, np.int64), scores


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best; both inputs (vec_id, v) of whole numbers."""
    one = queries.groupBy("vec_id").agg(F.max("v").alias("v")).withColumn("times", F.lit(1).cast("long"))
    each = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    nv, nq = vectors.count(), one.count()
    vb, qb = max(1, -(-nv // max(VECTOR_BLOCK, min(WIDEST_BLOCK, nv // BLOCKS)))), max(1, -(-nq // QUERY_BLOCK))
    asks = packed(one, qb, "q").select(F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("kind").alias("qkind"), F.col("mat").alias("qmat"))
    # each query block is sent to every vector block of its dimension, keyed by the block
    asks = asks.withColumn("qblock", F.explode(F.sequence(F.lit(0), F.lit(vb - 1))))
    have = packed(each, vb, "v")
    # by sorting: query blocks stream past the one block of vectors of their key
    met = asks.join(have.hint("merge"), (have.dim == asks.qdim) & (have.block == asks.qblock)).select("dim", "ids", "times", "kind", "mat", "qids", "qkind", "qmat")

    def run(batches):
        for batch in batches:
            for dim, ids, times, kind, mat, qids, qkind, qmat in zip(*(batch.column(i) for i in range(8))):
                d = dim.as_py()
                whole = [np.frombuffer(b.as_py(), np.int64) for b in (ids, times, qids)]
                x, q = (np.frombuffer(b.as_py(), t.as_py()).astype(np.float64).reshape(-1, d) for b, t in ((mat, kind), (qmat, qkind)))
                row, vec, score = maxscore(q, whole[2], x, whole[0], k, whole[1])
                # at the ends of a long and beyond: the nearest long, and bytes that sort like the true values
                near = [min(max(v, -LONG - 1), LONG) for v in score]
                over = [(v + BEYOND).to_bytes(BEYOND.bit_length() // 8 + 1, "big") if not -LONG <= n < LONG else None for v, n in zip(score, near)]
                yield pa.RecordBatch.from_arrays([pa.array(whole[2][row], pa.int64()), pa.array(vec, pa.int64()), pa.array(near, pa.int64()), pa.array(over, pa.binary())], names=["query_id", "vec_id", "score", "over"])

    with arrow_rows(vectors.sparkSession, 1):
        found = stage(met.mapInArrow(run, "query_id long, vec_id long, score long, over binary"), "topk")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("over"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def divisible(column: Column, n: int) -> Column:
    return F.pmod(column, F.lit(n)) == 0
