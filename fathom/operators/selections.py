"""Selections of a curation workbench: scopes, saved views, resumable dedup by shards, constrained diversity, comparisons, evaluation of a queue."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import digest
from ..shared import stage
from .curate import representatives, similar_links


@dataclass(frozen=True)
class Selection:
    """Ids chosen from a table by steps, each of which gives a new selection and leaves this one as it is."""

    rows: DataFrame
    key: str
    steps: tuple[str, ...] = field(default=())

    def ids(self) -> DataFrame:
        return self.rows.select(self.key).distinct()

    def where(self, condition: Column, name: str) -> Selection:
        return Selection(self.rows.where(condition), self.key, (*self.steps, name))

    def scope(self, ids: Sequence | None = None, tag: str | None = None, tags: str = "tags", **equal) -> Selection:
        """Rows of given ids, with a coverage tag, and with columns equal to given values."""
        ok = F.lit(True)
        if ids is not None:
            ok = ok & F.col(self.key).isin(list(ids))
        if tag is not None:
            ok = ok & F.array_contains(tags, tag)
        for c, v in equal.items():
            ok = ok & F.col(c).eqNullSafe(F.lit(v))
        return self.where(ok, "scope")

    def minus(self, other: DataFrame, name: str) -> Selection:
        return Selection(self.rows.join(other.select(self.key).distinct(), self.key, "left_anti"), self.key, (*self.steps, name))

    def decided(self, decisions: DataFrame) -> Selection:
        """Without the ids whose last decision (key, at, decision) excludes or rejects them."""
        last = decisions.groupBy(self.key).agg(F.max(F.struct("at", "decision")).alias("d")).where(F.col("d.decision").isin("exclude", "reject"))
        return self.minus(last, "decisions")

    def report(self) -> dict:
        return {"n": self.ids().count(), "steps": list(self.steps)}


def save_view(selection: Selection, order: Sequence, version: int, chunk: int = 1000) -> DataFrame:
    """(view_id, version, chunk, ordinal, key): a pinned order of a selection, in chunks; the id is a digest of steps and version."""
    from .timeline import global_numbers

    rows = global_numbers(selection.rows.select(selection.key, *[c for c in order if c != selection.key]).distinct(), [*order], "ordinal")
    ident = digest(F.lit("|".join(selection.steps)), F.lit(version), prefix="view-")
    return rows.select(ident.alias("view_id"), F.lit(version).alias("version"), F.floor(F.col("ordinal") / chunk).cast("long").alias("chunk"), "ordinal", selection.key)


def id_page(view: DataFrame, offset: int, limit: int, key: str) -> DataFrame:
    """A page of a saved view's ids by offset."""
    return view.where((F.col("ordinal") >= offset) & (F.col("ordinal") < offset + limit)).select("ordinal", key)


class DedupJob:
    """Near-duplicate groups shard by shard, each shard's memberships written once under the job's folder: a job that broke off goes on with what is missing."""

    def __init__(self, df: DataFrame, root: str, threshold: float, key: str, column: str, shard: str):
        self.df, self.root, self.threshold, self.key, self.column, self.shard = df, root.rstrip("/"), threshold, key, column, shard

    def _done(self) -> set[str]:
        from ..sources.lake import Files

        files = Files(self.df.sparkSession, self.root)
        return {n[len("shard=") :] for n in files.names(self.root) if n.startswith("shard=") and "_SUCCESS" in files.names(f"{self.root}/{n}")}

    def shards(self) -> list[str]:
        return sorted(str(r[0]) for r in self.df.where(F.col(self.shard).isNotNull()).select(self.shard).distinct().collect())

    def run(self, most: int | None = None) -> int:
        """Work on the shards that are missing, at most so many of them; how many are left."""
        todo = [s for s in self.shards() if s not in self._done()]
        for s in todo[:most]:
            rows = self.df.where(F.col(self.shard).cast("string") == s)
            links = similar_links(rows, self.threshold, self.key, self.column, self.shard)
            representatives(rows, links, self.key, [F.col(self.key)]).write.mode("overwrite").parquet(f"{self.root}/shard={s}")
        return len(todo[most:]) if most is not None else 0

    def memberships(self) -> DataFrame:
        """(key, group, kept) of all shards; refuses a job that isn't complete."""
        missing = [s for s in self.shards() if s not in self._done()]
        if missing:
            raise RuntimeError(f"{len(missing)} shards are missing; run the job under {self.root} again")
        return self.df.sparkSession.read.parquet(*[f"{self.root}/shard={s}" for s in self.shards()])


def constrained_sample(df: DataFrame, limit: int, key: str, column: str, dimension: str, minimum: Mapping[str, int] | None = None, maximum: Mapping[str, int] | None = None, quality: tuple[str, float] | None = None, candidates: int = 200) -> tuple[DataFrame, list[dict]]:
    """(key, position), and a report of each constraint: a farthest-first sample under minima and maxima by the values of a dimension.

    Of each value the `candidates` best rows (by quality, then key) are the pool, gathered on the driver: a documented bound on pool, not on input; counts of what
    is feasible cover all rows. Minima come first, then the farthest row that no maximum bars."""
    minimum, maximum = dict(minimum or {}), dict(maximum or {})
    ok = df.where(F.col(column).isNotNull() & F.col(dimension).isNotNull())
    if quality:
        ok = ok.where(F.col(quality[0]) >= quality[1])
    feasible = {r[0]: r[1] for r in ok.groupBy(dimension).count().collect()}
    order = [F.desc(quality[0]), F.col(key)] if quality else [F.col(key)]
    pool = ok.withColumn("__r", F.row_number().over(Window.partitionBy(dimension).orderBy(*order))).where(F.col("__r") <= candidates).select(key, dimension, column).orderBy(key).collect()
    x = np.array([r[2] for r in pool], float).reshape(len(pool), -1)
    names = [r[1] for r in pool]
    far, taken, have = np.full(len(pool), np.inf), [], {}

    def take(among):
        best = max(among, key=lambda i: (round(far[i], 9), -i))
        taken.append(best)
        have[names[best]] = have.get(names[best], 0) + 1
        far[:] = np.minimum(far, np.sqrt(((x - x[best]) ** 2).sum(axis=1)))

    for value, need in sorted(minimum.items()):
        while have.get(value, 0) < need and len(taken) < limit and (left := [i for i in range(len(pool)) if i not in taken and names[i] == value]):
            take(left)
    while len(taken) < limit and (left := [i for i in range(len(pool)) if i not in taken and have.get(names[i], 0) < maximum.get(names[i], limit)]):
        take(left)
    report = [{"constraint": f"min:{v}", "wanted": n, "got": have.get(v, 0), "feasible_count": feasible.get(v, 0), "status": "satisfied" if have.get(v, 0) >= n else "violated"} for v, n in sorted(minimum.items())]
    report += [{"constraint": f"max:{v}", "wanted": n, "got": have.get(v, 0), "feasible_count": feasible.get(v, 0), "status": "satisfied" if have.get(v, 0) <= n else "violated"} for v, n in sorted(maximum.items())]
    kind = df.schema[key].dataType.simpleString()
    return df.sparkSession.createDataFrame([(pool[i][0], p) for p, i in enumerate(taken)], f"{key} {kind}, position int"), report


#: Metrics of a comparison by name: a function of (old rows, new rows) that gives (slice, value).
METRICS: dict = {}


def register_metric(name: str, f) -> None:
    METRICS[name] = f


def compare(old: DataFrame, new: DataFrame, key: str, by: str, metrics: Sequence[str] = ()) -> DataFrame:
    """(slice, metric, value): members shared, removed and added of each slice, their Jaccard index, and registered metrics."""
    unknown = [m for m in metrics if m not in METRICS]
    if unknown:
        raise KeyError(f"no metric {unknown}; known: {sorted(METRICS)}")
    a, b = old.select(F.col(key), F.col(by).alias("a")).distinct(), new.select(F.col(key), F.col(by).alias("b")).distinct()
    both = a.join(b, key, "full").withColumn("slice", F.coalesce("b", "a"))
    shared, removed, added = (F.count_if(c) for c in (F.col("a").isNotNull() & F.col("b").isNotNull(), F.col("b").isNull(), F.col("a").isNull()))
    counts = both.groupBy("slice").agg(shared.alias("shared"), removed.alias("removed"), added.alias("added"), F.count("*").alias("n"))
    rows = counts.select("slice", F.explode(F.create_map(F.lit("shared"), F.col("shared").cast("double"), F.lit("removed"), F.col("removed").cast("double"), F.lit("added"), F.col("added").cast("double"), F.lit("jaccard"), F.col("shared") / F.col("n"))).alias("metric", "value"))
    for m in metrics:
        rows = rows.unionByName(METRICS[m](old, new).select("slice", F.lit(m).alias("metric"), F.col("value").cast("double").alias("value")))
    return rows


def stale(pinned: Mapping[str, int], versions: Mapping[str, int]) -> list[str]:
    """The tables that a comparison or view was made of and that have moved since."""
    return sorted(t for t, v in pinned.items() if versions.get(t) != v)


def evaluate_selection(scored: DataFrame, limit: int, key: str, score: str, confidence: str, seed: str) -> DataFrame:
    """(strategy, n, mean_priority, overlap, jaccard): the `limit` rows of highest score against as many by a seeded hash and by least confidence."""
    chosen = {
        "scored": [F.desc(score), F.col(key)],
        "random": [F.sha1(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), F.col(key)],
        "low_confidence": [F.asc(confidence), F.col(key)],
    }
    parts = {name: stage(scored.orderBy(*order).limit(limit).select(key, F.col(score).alias("s")), name) for name, order in chosen.items()}
    out = None
    for name, rows in parts.items():
        hits = rows.join(parts["scored"].select(key, F.lit(1).alias("h")), key, "left")
        one = hits.agg(F.lit(name).alias("strategy"), F.count("*").alias("n"), F.avg("s").alias("mean_priority"), F.count("h").alias("overlap"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("jaccard", F.col("overlap") / (2 * F.col("n") - F.col("overlap")))
