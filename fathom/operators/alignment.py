"""Alignment views: a recipe for each stream on one grid of ticks, their flags and summary, vectors fetched last."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import align, stream_stats, tick_grid, wide_ticks


@dataclass(frozen=True)
class Stream:
    """How a stream is aligned; latency is taken off its times first."""

    method: str = "nearest"
    tolerance: int | None = None
    latency: int = 0


def sub_frame_bound(step: int, tolerance: int | None = None) -> int:
    """The error up to which a sample counts as on its tick: half a step, the tolerance, a millisecond, whichever is least, 1 at least for the first two."""
    return min([max(1, step // 2), 1_000_000] + ([max(1, tolerance)] if tolerance is not None else []))


def create_view(observations: DataFrame, streams: Mapping[str, Stream], rate: float, run: str = "run_id", stream: str = "topic", time: str = "t", value: str = "value", ids: str = "event_id") -> DataFrame:
    """(run, topic, t, id, value, error, status, confidence): every stream on the grid of its run, by its own recipe.

    The grid runs at `rate` ticks a second over all of a run's rows. One shuffle by (run, stream) for all streams of a method and tolerance."""
    if rate <= 0 or not streams:
        raise ValueError("a view needs a rate above 0 and a stream")
    for name, s in streams.items():
        if s.method not in ("nearest", "previous", "linear") or (s.tolerance or 0) < 0:
            raise ValueError(f"{name}: {s}")
    step = max(1, round(1e9 / rate))
    grid, out, recipes = tick_grid(observations, step, run, time), None, {}
    for name, s in streams.items():
        recipes.setdefault((s.method, s.tolerance), []).append(name)
    late = F.create_map(*[F.lit(x) for n, s in streams.items() for x in (n, int(s.latency))])
    rows = observations.where(F.col(stream).isin(*streams)).withColumn(time, F.col(time) - late[F.col(stream)])
    for (method, tolerance), names in recipes.items():
        ticks = grid.withColumn(stream, F.explode(F.array(*map(F.lit, names))))
        part = align(ticks, rows.where(F.col(stream).isin(*names)), [run, stream], method, tolerance, step, time, value, ids)
        out = part if out is None else out.unionByName(part)
    return out


def flags(view: DataFrame, run: str = "run_id", stream: str = "topic") -> DataFrame:
    """(run, flag): alignment:<stream>:<reason> of each stream of a run that has ticks without a sample or beyond the tolerance."""
    bad = view.where(F.col("status").isin("missing", "out_of_tolerance")).select(run, F.concat(F.lit("alignment:"), F.col(stream), F.lit(":"), F.col("status")).alias("flag"))
    return bad.distinct()


def drift_flags(observations: DataFrame, step: int, received: str, tolerance: int | None = None, run: str = "run_id", stream: str = "topic", time: str = "t") -> DataFrame:
    """(run, topic, n, median_interval, dropped, drift, flags): stream statistics with dropped_frames and clock_drift flags; a drift counts beyond the tolerance, or half a step."""
    limit = step // 2 if tolerance is None else tolerance
    stats = stream_stats(observations, [run, stream], time, received)
    marks = F.array_compact(F.array(F.when(F.col("dropped") > 0, "dropped_frames"), F.when(F.col("drift") > limit, "clock_drift")))
    return stats.withColumn("flags", marks)


def summary(view: DataFrame, run: str = "run_id", stream: str = "topic") -> DataFrame:
    """(run, ticks, mean_confidence, min_confidence, max_error, mean_error, flags) of each run's view; a tick's confidence is the least of its streams'."""
    ticks = view.groupBy(run, "t").agg(F.min("confidence").alias("c")).groupBy(run).agg(F.count("*").alias("ticks"), F.avg("c").alias("mean_confidence"), F.min("c").alias("min_confidence"))
    errors = view.groupBy(run).agg(F.max("error").alias("max_error"), F.avg("error").alias("mean_error"))
    marks = flags(view, run, stream).groupBy(run).agg(F.array_sort(F.collect_set("flag")).alias("flags"))
    return ticks.join(errors, run).join(marks, run, "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def hydrate(view: DataFrame, rows: DataFrame, columns: list[str], ids: str = "event_id") -> DataFrame:
    """The view with columns of the rows that it refers to, joined last and only these columns read."""
    side = rows.select(F.col(ids).alias("__id"), *columns)
    return view.join(side, F.col("id") == F.col("__id"), "left").drop("__id")


def backfill_ticks(view: DataFrame, streams: Mapping[str, Stream], known: DataFrame | None = None, run: str = "run_id", stream: str = "topic") -> DataFrame:
    """The wide ticks of a view, with `verified`: whether a table of known ticks (run, t, vals) holds the same values, null without one."""
    wide = wide_ticks(view, run, stream, sorted(streams))
    if known is None:
        return wide.withColumn("verified", F.lit(None).cast("boolean"))
    old = known.select(F.col(run).alias("__r"), F.col("t").alias("__t"), F.array_sort(F.map_entries("vals")).alias("__v"))
    same = F.coalesce(F.array_sort(F.map_entries("vals")).eqNullSafe(F.col("__v")) & F.col("__r").isNotNull(), F.lit(False))
    return wide.join(old, (F.col(run) == F.col("__r")) & (F.col("t") == F.col("__t")), "left").withColumn("verified", same).drop("__r", "__t", "__v")
