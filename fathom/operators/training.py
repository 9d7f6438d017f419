"""Training data plane: epoch orders, worker shards, resume, batches, plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import global_numbers


def permutation(df: DataFrame, key: str, plan: str, seed: int) -> DataFrame:
    """Rows with `position`, a permutation fixed by the plan and the seed: the rank of a SHA-256 of both and the key."""
    h = F.sha2(F.concat_ws("|", F.lit(plan), F.lit(str(seed)), F.col(key).cast("string")), 256)
    return global_numbers(df.withColumn("__h", h), ["__h", key], "position").drop("__h")


def epoch_order(df: DataFrame, key: str, plan: str, seed: int, epoch: int) -> DataFrame:
    """The permutation rotated to the left by the epoch."""
    base = permutation(df, key, plan, seed)
    n = base.agg(F.count("*").alias("__n"))  # one row
    return base.crossJoin(F.broadcast(n)).withColumn("position", F.pmod(F.col("position") - F.pmod(F.lit(epoch), F.greatest("__n", F.lit(1))), F.greatest("__n", F.lit(1)))).drop("__n")


def worker_shard(ordered: DataFrame, worker: int, workers: int, resume: int = 0) -> DataFrame:
    """Every workers-th row from the resume point on, numbered by `step`."""
    if not 0 <= worker < workers or resume < 0:
        raise ValueError("0 <= worker < workers and resume >= 0")
    if resume and (n := ordered.count()) < resume:
        raise ValueError(f"resume at {resume} of {n} rows")
    rest = F.col("position") - resume
    return ordered.where((rest >= 0) & (rest % workers == worker)).withColumn("step", F.floor(rest / workers).cast("long"))


def batches(ordered: DataFrame, size: int, key: str, vector: str | None = None) -> DataFrame:
    """(batch, n, keys[, width, rows, mask]): collated batches, vectors padded to the widest of the batch."""
    b = F.floor(F.col("position") / size).cast("long").alias("batch")
    item = F.struct("position", F.col(key).alias("key"), *([F.col(vector).alias("v")] if vector else []))
    got = ordered.groupBy(b).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    out = got.select("batch", "n", F.col("items.key").alias("keys"), *([F.col("items.v").alias("vs")] if vector else []))
    if not vector:
        return out
    width = F.array_max(F.transform("vs", lambda v: F.size(v)))
    out = out.withColumn("width", width)
    pad = lambda v, x: F.array_repeat(x, F.greatest(F.col("width") - F.size(v), F.lit(0)))
    rows = F.transform("vs", lambda v: F.concat(F.transform(v, lambda x: x.cast("double")), pad(v, F.lit(0.0))))
    mask = F.transform("vs", lambda v: F.concat(F.transform(v, lambda x: F.lit(True)), pad(v, F.lit(False))))
    return out.withColumn("rows", rows).withColumn("mask", mask).drop("vs")


def report(df: DataFrame, sums: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Summed metrics overall and by each prefix of `by`, nulls as 0."""
    return df.rollup(*by).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums])


def dataset(snapshot: DataFrame, rows: DataFrame, key: str, columns: Sequence[str], order: Sequence[str], where=None, plan: str | None = None, seed: int = 0, epoch: int = 0, worker: int = 0, workers: int = 1, resume: int = 0) -> DataFrame:
    """The rows of a snapshot's members (key, ...) with `position` and `step`, pinned columns only: in the given order, or shuffled if a plan is named.

    A member that the rows don't have is an error: a dataset never shrinks without a word. The filter holds after that check."""
    gone = snapshot.select(key).distinct().join(rows.select(key), key, "left_anti").limit(3).collect()
    if gone:
        raise ValueError(f"members without rows: {[r[0] for r in gone]}")
    found = rows.join(snapshot.select(key).distinct(), key, "left_semi")
    if where is not None:
        found = found.where(where)
    need = list(dict.fromkeys([key, *columns, *order]))
    found = found.select(*need)
    placed = epoch_order(found, key, plan, seed, epoch) if plan is not None else global_numbers(found, [*order, key], "position")
    return worker_shard(placed, worker, workers, resume).select(key, *[c for c in columns if c != key], "position", "step")


def preview(ordered: DataFrame, n: int) -> DataFrame:
    """The first n samples."""
    return ordered.where(F.col("position") < n)
