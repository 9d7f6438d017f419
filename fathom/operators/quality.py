"""Run validation: five rules over all runs at once, and the flags that follow."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import first_disorder


def required_topics(obs: DataFrame, required: Mapping[str, int], run: str = "run_id", topic: str = "topic") -> DataFrame:
    """(run, status): every required topic has its least number of messages; a topic that is missing fails."""
    counts = [F.count_if(F.col(topic) == name) >= least for name, least in required.items()]
    ok = F.lit(True)
    for c in counts:
        ok = ok & c
    return obs.groupBy(run).agg(F.when(ok, "passed").otherwise("failed").alias("status"))


def overlapping(obs: DataFrame, topics: list[str], run: str = "run_id", topic: str = "topic", time: str = "t") -> DataFrame:
    """(run, status): the required topics that are present share some time; fewer than two pass."""
    spans = obs.where(F.col(topic).isin(*topics)).groupBy(run, topic).agg(F.min(time).alias("a"), F.max(time).alias("b"))
    got = spans.groupBy(run).agg(F.when((F.count("*") < 2) | (F.max("a") <= F.min("b")), "passed").otherwise("failed").alias("status"))
    return obs.select(run).distinct().join(got, run, "left").select(run, F.coalesce("status", F.lit("passed")).alias("status"))


def share_rule(obs: DataFrame, good: Column, known: Column, run: str = "run_id") -> DataFrame:
    """(run, status): every row for which the answer is known is good; skipped if it is known for none."""
    return obs.groupBy(run).agg(F.when(F.count_if(known) == 0, "skipped").when(F.count_if(known & ~good) == 0, "passed").otherwise("failed").alias("status"))


def validate(obs: DataFrame, required: Mapping[str, int], run: str = "run_id", topic: str = "topic", time: str = "t", seq: str = "event_id", decoded: Column | None = None, intact: Column | None = None) -> DataFrame:
    """(run, rule, status) of the five rules for every run."""
    unknown = F.lit(None).cast("boolean")
    mono = first_disorder(obs, [run, topic], time, seq).groupBy(run).agg(F.when(F.bool_and("ok"), "passed").otherwise("failed").alias("status"))
    decoded, intact = (unknown if c is None else c for c in (decoded, intact))
    rules = {
        "required-topics": required_topics(obs, required, run, topic),
        "monotonic-timestamps": mono,
        "time-range-overlap": overlapping(obs, list(required), run, topic, time),
        "decodable-streams": share_rule(obs, F.coalesce(decoded, F.lit(False)), decoded.isNotNull(), run),
        "byte-integrity": share_rule(obs, F.coalesce(intact, F.lit(False)), intact.isNotNull(), run),
    }
    out = None
    for name, df in rules.items():
        part = df.select(run, F.lit(name).alias("rule"), "status")
        out = part if out is None else out.unionByName(part)
    return out


def quality_flags(results: DataFrame, profile: str, run: str = "run_id") -> DataFrame:
    """(run, passed, flags): the profile's verdict, the rules that failed, and quarantined where any did."""
    failed = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.concat(F.lit("quality:failed:"), F.col("rule")))))
    g = results.groupBy(run).agg(failed.alias("bad"))
    ok = F.size("bad") == 0
    return g.select(run, ok.alias("passed"), F.when(ok, F.array(F.lit(f"quality:{profile}:passed"))).otherwise(F.concat(F.array(F.lit(f"quality:{profile}:failed")), F.col("bad"), F.array(F.lit("quarantined")))).alias("flags"))
