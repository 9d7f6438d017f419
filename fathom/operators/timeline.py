"""Operators over time-stamped rows and intervals: windows, markers, gaps and islands, alignment, paging.

Every function takes and returns DataFrames, names its columns, and orders by a total key, so results don't
depend on partitioning. Times are 64-bit integers (nanoseconds). Rows are grouped by run (and stream), so work spreads
over runs; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import stage


def _cols(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def tumbling_windows(df: DataFrame, width: int, run: str = "run_id", time: str = "t", topic: str = "topic", ids: str = "event_id") -> DataFrame:
    """Windows anchored at each run's first time: half-open, the last one closed at the run's end; no empty ones.

    (run, idx, start, end, n, topics sorted distinct, ids in (time, id) order, is_partial)"""
    span = df.groupBy(run).agg(F.min(time).alias("s"), F.max(time).alias("z"))
    last = F.greatest(F.ceil((F.col("z") - F.col("s")) / width) - 1, F.lit(0))
    rows = df.join(span, run).withColumn("idx", F.least(F.floor((F.col(time) - F.col("s")) / width), last).cast("long"))
    out = rows.groupBy(run, "idx", "s", "z").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_set(topic)).alias("topics"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(time), F.col(ids)))), lambda x: x[ids]).alias("ids")
    )
    start = F.col("s") + F.col("idx") * width
    return out.select(run, "idx", start.alias("start"), F.least(start + width, F.col("z")).alias("end"), "n", "topics", "ids", (start + width > F.col("z")).alias("is_partial"))


def merge_intervals(df: DataFrame, gap: int = 0, key: str | Sequence[str] = "run_id", start: str = "start", end: str = "end", tie: str | Sequence[str] = ()) -> DataFrame:
    """Gaps and islands: intervals that start no later than `gap` after the greatest end so far are one. (key, start, end, n)"""
    by, order = _cols(key), [start, end, *_cols(tie)]
    w = Window.partitionBy(*by).orderBy(*order)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(seen.isNull() | (F.col(start) > seen + gap), 1).otherwise(0)
    rows = df.withColumn("__new", new).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*by, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def pair_markers(df: DataFrame, starts: Sequence[str], stops: Sequence[str], run: str = "run_id", time: str = "t", kind: str = "topic", tie: str = "event_id") -> DataFrame:
    """Episodes between markers: the last start before a stop opens, the first stop after it closes; dangling starts are dropped. (run, start, end, start_id, end_id)"""
    marks = df.where(F.col(kind).isin(*starts, *stops)).withColumn("__s", F.col(kind).isin(*starts))
    w = Window.partitionBy(run).orderBy(time, tie)
    # a start that follows a start replaces it, so each start opens a group of its own
    marks = marks.withColumn("__g", F.sum(F.col("__s").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__g > 0")
    ends = marks.groupBy(run, "__g").agg(F.min(F.when(F.col("__s"), F.struct(time, tie))).alias("a"), F.min(F.when(~F.col("__s"), F.struct(time, tie))).alias("b"))
    return ends.where("b is not null").select(run, F.col(f"a.{time}").alias("start"), F.col(f"b.{time}").alias("end"), F.col(f"a.{tie}").alias("start_id"), F.col(f"b.{tie}").alias("end_id"))


def mine_predicate(df: DataFrame, hit: Column, before: int, after: int, merge_gap: int = 0, min_length: int = 0, max_length: int | None = None, run: str = "run_id", time: str = "t") -> DataFrame:
    """Intervals around rows that satisfy a predicate, clipped to their run, merged, filtered by length. (run, start, end, n)"""
    span = df.groupBy(run).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    hits = df.where(hit).join(span, run).select(run, F.greatest(F.col(time) - before, F.col("__lo")).alias("start"), F.least(F.col(time) + after, F.col("__hi")).alias("end"))
    out = merge_intervals(hits, merge_gap, run)
    length = F.col("end") - F.col("start")
    out = out.where(length >= min_length)
    return out if max_length is None else out.where(length <= max_length)


def rows_in_intervals(rows: DataFrame, intervals: DataFrame, bucket: int, run: str = "run_id", time: str = "t", start: str = "start", end: str = "end") -> DataFrame:
    """Rows with start <= time <= end of an interval of their run: an equi-join on (run, time bucket), then the exact test.

    An interval is repeated for each bucket of `bucket` time units that it touches, a row for none."""
    cells = F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))
    wide = intervals.withColumnRenamed(run, "__run").withColumn("__cell", F.explode(cells))
    met = rows.withColumn("__c", F.floor(F.col(time) / bucket)).join(wide, (F.col(run) == F.col("__run")) & (F.col("__c") == F.col("__cell")))
    return met.where(F.col(time).between(F.col(start), F.col(end))).drop("__run", "__cell", "__c")


def first_disorder(df: DataFrame, key: Sequence[str], time: str, seq: str) -> DataFrame:
    """For each stream: is time strictly rising in sequence order, and where not first. (key, ok, first_bad_seq)"""
    prev = F.lag(time).over(Window.partitionBy(*key).orderBy(seq))
    return df.withColumn("__bad", F.col(time) <= prev).groupBy(*key).agg(F.min(F.when(F.col("__bad"), F.col(seq))).alias("first_bad_seq")).withColumn("ok", F.col("first_bad_seq").isNull())


def latest(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order, by a map-side-combined maximum."""
    keys = _cols(key)
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__r"))
    return best.select(*keys, *[F.col(f"__r.{c}").alias(c) for c in (*order, *rest)])


def history(df: DataFrame, key: str | Sequence[str], order: Sequence[str], row_id: str) -> DataFrame:
    """Every row with the id of the one that it supersedes."""
    return df.withColumn("supersedes", F.lag(row_id).over(Window.partitionBy(*_cols(key)).orderBy(*order)))


def retain_latest(df: DataFrame, key: str | Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The n last rows of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*_cols(key)).orderBy(*[F.desc(c) for c in order]))).where(F.col("__r") <= n).drop("__r")


def number_rows(df: DataFrame, key: str | Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Dense numbers from 0 within a key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*_cols(key)).orderBy(*order)) - 1).cast("long"))


def global_numbers(df: DataFrame, order: Sequence[str], name: str, buckets: int = 64) -> DataFrame:
    """Dense numbers from 0 over all rows: rows are ranged by the order columns, numbered within a range, and each range's count is added up.

    Bounds of ranges are sampled anew whenever the plan runs, so the rows are staged with their places: counts and places then come from the same ranges."""
    taken, at = {c.lower() for c in [*df.columns, name]}, "__at"
    while {at, f"{at}p", f"{at}b"} & taken:
        at += "_"
    # the number of the range, shifted by 33 bits, and the place within it
    placed = stage(df.repartitionByRange(buckets, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbers")
    p, i = F.shiftright(at, 33), F.col(at).bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(p.alias(f"{at}p")).agg(F.count("*").alias("n"))
    base = sizes.select(f"{at}p", F.coalesce(F.sum("n").over(Window.orderBy(f"{at}p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"{at}b"))
    # a row for each range
    return placed.join(F.broadcast(base), p == F.col(f"{at}p")).withColumn(name, (F.col(f"{at}b") + i).cast("long")).drop(at, f"{at}p", f"{at}b")


def page_after(df: DataFrame, order: Sequence[str], after: Sequence, limit: int) -> DataFrame:
    """Keyset pagination: the first `limit` rows past a key."""
    past = F.lit(False)
    for i in range(len(order)):
        same = F.lit(True)
        for j in range(i):
            same = same & (F.col(order[j]) == F.lit(after[j]))
        past = past | (same & (F.col(order[i]) > F.lit(after[i])))
    return df.where(past).orderBy(*order).limit(limit)


# Alignment: ticks and samples are sorted together per stream, and each tick looks to its neighbours.


def tick_grid(df: DataFrame, step: int, run: str = "run_id", time: str = "t") -> DataFrame:
    """A regular grid over each run, both ends included. (run, t)"""
    return df.groupBy(run).agg(F.min(time).alias("lo"), F.max(time).alias("hi")).select(run, F.explode(F.sequence("lo", "hi", F.lit(step))).alias(time))


def neighbours(ticks: DataFrame, samples: DataFrame, key: Sequence[str], time: str = "t", value: str = "value", ids: str = "event_id") -> DataFrame:
    """Each tick with the sample at or before it (p) and the one at or after it (n), structs of (t, id, v); no join is needed.

    Of samples at one time the smallest id counts."""
    keys = _cols(key)
    one = samples.groupBy(*keys, time).agg(F.min(F.struct(F.col(ids).alias("id"), F.col(value).alias("v"))).alias("s"))
    both = one.select(*keys, F.col(time), F.struct(F.col(time).alias("t"), F.col("s.id").alias("id"), F.col("s.v").alias("v")).alias("s")).unionByName(ticks.select(*keys, F.col(time)).distinct(), allowMissingColumns=True)
    order = Window.partitionBy(*keys)
    back = F.last("s", ignorenulls=True).over(order.orderBy(time, F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    fore = F.last("s", ignorenulls=True).over(order.orderBy(F.desc(time), F.col("s").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("p", back).withColumn("n", fore).where("s is null").drop("s")


def align(ticks: DataFrame, samples: DataFrame, key: Sequence[str], method: str = "nearest", tolerance: int | None = None, step: int | None = None, time: str = "t", value: str = "value", ids: str = "event_id") -> DataFrame:
    """As-of alignment: previous, nearest (ties to the earlier) or linear. (key, t, id, value, error, status, confidence)

    status: aligned, interpolated, out_of_tolerance (kept, with its id), missing. confidence: 1 on an exact hit, 1 - error / tolerance
    within tolerance, 1 / (1 + error / step) without one."""
    t = F.col(time)
    dp, dn = t - F.col("p.t"), F.col("n.t") - t
    rows = neighbours(ticks, samples, key, time, value, ids)
    if method == "previous":
        rows = rows.withColumn("c", F.col("p")).withColumn("out", F.col("p.v"))
    elif method == "nearest":
        rows = rows.withColumn("c", F.when(F.col("n").isNull() | (dp <= dn), F.col("p")).otherwise(F.col("n"))).withColumn("out", F.col("c.v"))
    elif method == "linear":
        rows = rows.withColumn("c", F.when(F.col("n").isNull() | (dp <= dn), F.col("p")).otherwise(F.col("n")))
        frac = dp / (F.col("n.t") - F.col("p.t"))
        rows = rows.withColumn("out", F.when(dp == 0, F.col("p.v")).when(F.col("p").isNotNull() & F.col("n").isNotNull(), F.col("p.v") + (F.col("n.v") - F.col("p.v")) * frac))
    else:
        raise ValueError(f"unknown method {method!r}")
    err = F.abs(t - F.col("c.t"))
    late = F.lit(False) if tolerance is None else err > tolerance
    status = F.when(F.col("c").isNull() | F.col("out").isNull(), "missing").when(late, "out_of_tolerance").when(F.lit(method == "linear") & (err > 0), "interpolated").otherwise("aligned")
    if tolerance is not None:
        sure = F.greatest(F.lit(0.0), 1 - err / tolerance) if tolerance else F.lit(0.0)
    else:
        sure = 1 / (1 + err / (step or 1))
    conf = F.when(status == "missing", 0.0).when(err == 0, 1.0).otherwise(sure)
    return rows.select(*_cols(key), t, F.col("c.id").alias("id"), F.col("out").alias("value"), err.alias("error"), status.alias("status"), conf.alias("confidence"))


def stream_stats(df: DataFrame, key: Sequence[str], time: str = "t", received: str | None = None) -> DataFrame:
    """Median interval of each stream (exact, cut to an integer), dropped frames, and the drift of latency. (key, n, median_interval, dropped, drift)"""
    keys = _cols(key)
    gaps = df.withColumn("__gap", F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(time)))
    late = (F.col(received) - F.col(time)) if received else F.lit(0)
    per = gaps.groupBy(*keys).agg(F.count("*").alias("n"), F.floor(F.median("__gap")).cast("long").alias("median_interval"), (F.max(late) - F.min(late)).cast("long").alias("drift"))
    lost = F.when(F.col("__gap") > 1.5 * F.col("median_interval"), F.greatest(F.lit(1), F.bround(F.col("__gap") / F.col("median_interval"), 0).cast("long") - 1)).otherwise(0)
    drops = gaps.join(per.select(*keys, "median_interval"), keys).groupBy(*keys).agg(F.sum(lost).cast("long").alias("dropped"))
    return per.join(drops, keys).select(*keys, "n", "median_interval", "dropped", "drift")


def wide_ticks(aligned: DataFrame, run: str, stream: str, streams: Sequence[str], time: str = "t") -> DataFrame:
    """Long aligned rows pivoted: a map of values, and the lists of streams by status. (run, t, vals, available, missing, interpolated, late, confidence)"""
    pick = lambda *s: F.array_sort(F.collect_list(F.when(F.col("status").isin(*s), F.col(stream))))
    out = aligned.groupBy(run, time).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(stream), "value")))).alias("vals"), pick("aligned", "interpolated").alias("available"), pick("interpolated").alias("interpolated"),
        pick("out_of_tolerance").alias("late"), F.min("confidence").alias("confidence"),
    )
    every = F.array(*[F.lit(s) for s in sorted(streams)])
    return out.withColumn("missing", F.array_except(every, F.array_union("available", "late")))


def tick_policy(aligned: DataFrame, run: str, stream: str, required: Sequence[str], min_confidence: float = 0.0, time: str = "t") -> DataFrame:
    """Ticks at which every required stream is aligned with enough confidence. (run, t, n_streams)"""
    good = F.col("status").isin("aligned", "interpolated") & (F.col("confidence") >= min_confidence)
    out = aligned.where(F.col(stream).isin(*required)).groupBy(run, time).agg(F.count_if(good).alias("n_streams"))
    return out.where(F.col("n_streams") == len(required))


def offset_samples(df: DataFrame, offsets: Sequence[int], key: str, time: str = "t", index: str = "frame") -> DataFrame:
    """For each row and offset the row of its key nearest to time + offset, ties to the lower index. (key, index, offset, other)"""
    base = df.select(key, F.col(index), F.col(time), F.explode(F.array(*[F.lit(int(o)) for o in offsets])).alias("offset")).withColumn("at", F.col(time) + F.col("offset"))
    asks = base.select(key, F.col("at").alias(time)).distinct()
    near = neighbours(asks, df, [key], time, index, index)
    dp, dn = F.col(time) - F.col("p.t"), F.col("n.t") - F.col(time)
    near = near.select(key, F.col(time).alias("at"), F.when(F.col("n").isNull() | (dp <= dn), F.col("p.id")).otherwise(F.col("n.id")).alias("other"))
    return base.join(near, [key, "at"]).select(key, index, "offset", "other")
