"""Episodes: builders from search hits, scenarios and interval tables, and their life as a log of transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digest
from .timeline import merge_intervals

KINDS = ("create", "supersede", "clear")


def bounds(observations: DataFrame, run: str = "run_id", time: str = "t") -> DataFrame:
    """(run, lo, hi)"""
    return observations.groupBy(run).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))


def from_hits(hits: DataFrame, observations: DataFrame, before: int, after: int, run: str = "run_id", time: str = "t") -> DataFrame:
    """(run, start, end, n, source): an episode around each hit (run, t), clipped to its run; hits whose spans touch are one."""
    spans = hits.join(bounds(observations, run, time), run).select(run, F.greatest(F.col(time) - before, "lo").alias("start"), F.least(F.col(time) + after, "hi").alias("end"))
    return merge_intervals(spans, 0, run).withColumn("source", F.lit("query"))


def from_scenarios(scenarios: DataFrame, gap: int = 0, run: str = "run_id") -> DataFrame:
    """(run, start, end, n, source): neighbouring windows (run, start, end) that lie no more than `gap` apart are one episode."""
    return merge_intervals(scenarios.select(run, "start", "end"), gap, run).withColumn("source", F.lit("scenarios"))


def from_intervals(checked: DataFrame) -> DataFrame:
    """(run_id, start, end, external_id, source) of an interval manifest that check_intervals passed; raises if any row has a problem, so nothing is taken by halves."""
    bad = checked.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n")).orderBy("problem").collect()
    if bad:
        raise ValueError("intervals refused: " + ", ".join(f"{r.n} {r.problem}" for r in bad))
    return checked.select("run_id", F.col("from_timestamp_ns").alias("start"), F.col("to_timestamp_ns").alias("end"), "external_id", F.lit("intervals").alias("source"))


def identified(episodes: DataFrame, run: str = "run_id") -> DataFrame:
    """With a content id, so that the same build gives the same episodes."""
    return episodes.withColumn("episode_id", digest(run, "start", "end", "source", prefix="ep-"))


def planned(new: DataFrame, known: DataFrame) -> DataFrame:
    """A dry run: (episode_id, action) insert for new ids, keep for those that are there, clear for those of the known that are not built again."""
    n, k = new.select("episode_id", F.lit(True).alias("n")), known.select("episode_id", F.lit(True).alias("k"))
    action = F.when(F.col("k").isNull(), "insert").when(F.col("n").isNull(), "clear").otherwise("keep")
    return n.join(k, "episode_id", "full").select("episode_id", action.alias("action"))


def alive(log: DataFrame, key: str = "episode_id", at: str = "at", kind: str = "kind", by: str = "superseded_by", asof: Column | int | None = None) -> DataFrame:
    """The registry that a log of (episode_id, at, kind, superseded_by) folds to: (episode_id, state, superseded_by) as of a time.

    The last entry of an episode counts: created ones are active, superseded ones name their heir, cleared ones are gone but listed."""
    rows = log if asof is None else log.where(F.col(at) <= asof)
    last = rows.groupBy(key).agg(F.max(F.struct(at, kind, by)).alias("r"))
    state = F.when(F.col(f"r.{kind}") == "clear", "cleared").when(F.col(f"r.{kind}") == "supersede", "superseded").otherwise("active")
    return last.select(key, state.alias("state"), F.when(state == "superseded", F.col(f"r.{by}")).alias(by))


def numbered(episodes: DataFrame, run: str = "run_id") -> DataFrame:
    """Episodes of a run numbered from 0 in order of start, end."""
    return episodes.withColumn("ordinal", F.row_number().over(Window.partitionBy(run).orderBy("start", "end")) - 1)
