"""Slice distributions, bins, gaps against targets, snapshot comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def measure(df: DataFrame, label: str, quality: str | None = None, flagged: Column | None = None, labelled: str | None = None, duplicate: Column | None = None) -> DataFrame:
    """One grouped pass: count, share of the total, quality range and mean, flagged, labelled, duplicate pressure of each slice."""
    q = F.col(quality) if quality else F.lit(None).cast("double")
    no = F.lit(False)
    out = df.groupBy(label).agg(
        F.count("*").alias("n"), F.count(q).alias("n_quality"), F.min(q).alias("q_min"), F.max(q).alias("q_max"), F.avg(q).alias("q_mean"),
        F.count_if(flagged if flagged is not None else no).alias("n_flagged"), F.count(F.col(labelled) if labelled else F.lit(None)).alias("n_labelled"), F.count_if(duplicate if duplicate is not None else no).alias("n_duplicate"),
    )
    total = F.sum("n").over(Window.partitionBy())  # over slices, not rows
    return out.withColumn("share", F.col("n") / total).withColumn("completeness", F.col("n_labelled") / F.col("n")).withColumn("pressure", F.col("n_duplicate") / F.col("n"))


def rare_bucket(counts: DataFrame, least: int, label: str = "label", n: str = "n", bucket: str = "rare") -> DataFrame:
    """Slices under `least` rows become one."""
    return counts.withColumn(label, F.when(F.col(n) < least, bucket).otherwise(F.col(label))).groupBy(label).agg(F.sum(n).alias(n))


def overflow_bucket(counts: DataFrame, most: int, label: str = "label", n: str = "n", bucket: str = "other") -> DataFrame:
    """With more than `most` slices, all but the `most` - 1 largest (ties by label) become one."""
    ranked = counts.withColumn("__r", F.row_number().over(Window.orderBy(F.desc(n), label))).withColumn("__k", F.count("*").over(Window.partitionBy()))
    keep = (F.col("__k") <= most) | (F.col("__r") < most)
    return ranked.withColumn(label, F.when(keep, F.col(label)).otherwise(bucket)).groupBy(label).agg(F.sum(n).alias(n))


def gaps(observed: DataFrame, target: DataFrame, threshold: float = 0.05, label: str = "label") -> DataFrame:
    """Findings for observed (label, n) against target (label, min_count, target_pct): missing, under- or overrepresented, with severity."""
    total = observed.agg(F.sum("n").alias("total"))
    both = observed.join(target.withColumn("__t", F.lit(True)), label, "full_outer").crossJoin(F.broadcast(total))  # one row
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0))
    pct = F.when(total > 0, n / total).otherwise(0.0)
    want = F.coalesce("target_pct", F.lit(0.0))
    required = F.greatest(F.coalesce("min_count", F.lit(0)), F.ceil(want * total)).cast("long")
    needed = F.greatest(F.lit(0), required - n)
    kind = F.when((needed > 0) & (n == 0), "missing").when(needed > 0, "underrepresented").when(F.col("__t").isNull() | (F.col("target_pct").isNotNull() & (pct > want + threshold)), "overrepresented")
    out = both.select(label, n.cast("long").alias("n"), pct.alias("pct"), required.alias("required"), needed.alias("needed"), kind.alias("kind"), F.when(needed > 0, F.greatest(needed.cast("double"), want - pct)).otherwise(pct - want).alias("severity"))
    return out.where("kind is not null")


def feature_stats(df: DataFrame, key: str, *vectors: str) -> DataFrame:
    """All elements of the vectors as one population: count, mean, population deviation, range."""
    x = df.select(key, F.explode(F.flatten(F.array(*vectors))).alias("x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy(key).agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))


def nearest_rank(df: DataFrame, key: str, value: str, points: dict[str, float]) -> DataFrame:
    """Exact percentiles by nearest rank."""
    return df.groupBy(key).agg(*[F.expr(f"percentile_disc({p}) within group (order by `{value}`)").alias(name) for name, p in points.items()])


def compare_members(left: DataFrame, right: DataFrame, key: str, dimension: str) -> DataFrame:
    """Of two selections, per slice: members shared, only left (removed), only right (added), and Jaccard similarity."""
    both = left.select(key, F.col(dimension).alias("__l")).distinct().join(right.select(key, F.col(dimension).alias("__r")).distinct(), key, "full_outer")
    out = both.withColumn(dimension, F.coalesce("__l", "__r")).groupBy(dimension).agg(
        F.count_if(F.col("__l").isNotNull() & F.col("__r").isNotNull()).alias("shared"), F.count_if(F.col("__r").isNull()).alias("removed"), F.count_if(F.col("__l").isNull()).alias("added"),
    )
    return out.withColumn("jaccard", F.col("shared") / (F.col("shared") + F.col("removed") + F.col("added")))


def accounting(df: DataFrame, referenced: str, copied: Column) -> DataFrame:
    """Byte accounting: referenced, copied, logical (never below 0) and the copy ratio (0 without references)."""
    out = df.agg(F.coalesce(F.sum(referenced), F.lit(0)).alias("referenced"), F.coalesce(F.sum(F.when(copied, F.col(referenced))), F.lit(0)).alias("copied"))
    return out.withColumn("logical", F.greatest(F.lit(0), F.col("referenced") - F.col("copied"))).withColumn("copy_ratio", F.when(F.col("referenced") > 0, F.col("copied") / F.col("referenced")).otherwise(0.0))
