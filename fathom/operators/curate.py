"""Curation: near-duplicate groups, samples, mining, review queues, row plans, scorers of active learning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as fn
from ..shared import stage
from .graph import components

#: Vectors in a block, about; blocks are compared in slices of so many rows, and pairs leave in batches of so many.
BLOCK, SLICE, BATCH = 4096, 512, 1 << 16
#: Every block travels once for each block that it meets: from so many blocks on they grow, up to so many times and to so many components.
BLOCKS, GROWTH, COMPONENTS = 16, 8, 1 << 21


def _units(m: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """Rows of length 1 in single precision; zeros where a row has no length or none that is finite."""
    fit = np.isfinite(squares) & (squares > 0)
    out = np.zeros(m.shape, np.float32)
    np.divide(m, np.sqrt(squares)[:, None], out=out, where=fit[:, None], casting="unsafe")
    return out


def _cosine_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, blank: float = 0.0):
    """Batches (rows of x, rows of y, similarity) that reach the threshold or are NaN; of one block only pairs of a row and a later one.

    Products in single precision find the candidates, by a margin above their error; similarities are of double precision."""
    nx, ny = (np.cumsum(m * m, axis=1)[:, -1] for m in (x, y))
    u, v = _units(x, nx), _units(y, ny)
    odd_x, odd_y = (~np.isfinite(n) | ((n == 0) & np.isnan(blank)) for n in (nx, ny))
    least, batch = threshold - (x.shape[1] + 8) * 2.0**-23, max(1, BATCH * 64 // max(64, x.shape[1]))
    step = max(1, SLICE * BLOCK // max(BLOCK, len(y)))
    for at in range(0, len(x), step):
        first = at if same else 0
        likely = ~(u[at : at + step] @ v[first:].T < least)
        likely[odd_x[at : at + step]] = True
        likely[:, odd_y[first:]] = True
        i, j = np.nonzero(np.triu(likely, 1) if same else likely)
        for b in range(0, len(i), batch):
            p, q = i[b : b + batch] + at, j[b : b + batch] + first
            # one root of the product, as in SQL: the product of two roots can miss a threshold that is met exactly
            n = np.sqrt(nx[p] * ny[q])
            yield p, q, np.where(n == 0, blank, np.cumsum(x[p] * y[q], axis=1)[:, -1] / np.where(n == 0, 1.0, n))


def _matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows, filled with zeros up to the width: products then run over the common length. Rows whose squares could leave the range of doubles are scaled by a power of two."""
    sizes = np.asarray(vectors.value_lengths(), np.int64)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = np.asarray(vectors.flatten(), float)
    most = np.abs(out).max(axis=1)
    powers = np.frexp(np.where(np.isfinite(most), most, 0.0))[1]
    far = np.abs(powers) > 200
    out[far] = np.ldexp(out[far], -powers[far, None])
    return out


def _sharded(df: DataFrame, column: str, shard: str | Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    by = [] if shard is None else [shard] if isinstance(shard, str) else list(shard)
    rows = df.where(F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull()))
    for c in by:
        rows = rows.where(F.col(c).isNotNull())
    return rows, by


def similar_pairs(
    df: DataFrame, threshold: float, key: str, column: str, shard: str | Sequence[str] | None = None, most: int | None = None, block: int = BLOCK, blank: float = 0.0
) -> DataFrame:
    """(a, b, similarity) of rows whose cosine reaches the threshold, a < b: of all rows, or with `shard` of rows that share its values, null none.

    Every block of rows meets every block of its shard as matrices, so a shard may have any size; one over `most` rows is refused where that is given.
    A vector without length has the similarity `blank` to any other; NaN reaches every threshold."""
    rows, by = _sharded(df, column, shard)
    narrow = df.schema[column].dataType.elementType.simpleString() == "float"
    rows = rows.select(F.struct(*by, F.lit(0).alias("__all")).alias("s"), F.col(key).alias("id"), F.col(column).cast(f"array<{'float' if narrow else 'double'}>").alias("v"))
    worst, wide = (x or 0 for x in rows.groupBy("s").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("w")).agg(F.max("n"), F.max("w")).first())
    if most is not None and worst > most:
        raise ValueError(f"a shard of {worst} rows; all-pairs comparison takes up to {most}")
    grown = max(block, min(GROWTH * block, COMPONENTS // max(1, wide)))
    n = max(1, min(-(-worst // block), max(BLOCKS, -(-worst // grown))))
    dealt = rows.withColumn("at", F.pmod(F.xxhash64("id", F.lit("block")), F.lit(n)).cast("int"))
    blocks = dealt.groupBy("s", "at").agg(F.collect_list(F.struct("id", "v")).alias("r")).select("s", "at", F.col("r.id").alias("ids"), F.col("r.v").alias("vs"))
    # the blocks of a pair meet under the pair's own key; they are sorted, as their estimated size knows nothing of how often they travel
    x = blocks.select("s", F.col("at").alias("i"), F.explode(F.sequence(F.col("at"), F.lit(n - 1))).alias("j"), F.col("ids").alias("xi"), F.col("vs").alias("xv"))
    y = blocks.select("s", F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), F.col("ids").alias("yi"), F.col("vs").alias("yv"))
    met = x.join(y.hint("merge"), ["s", "i", "j"]).select((F.col("i") == F.col("j")).alias("same"), "xi", "xv", "yi", "yv")

    def run(batches):
        for batch in batches:
            for same, xi, xv, yi, yv in zip(*(batch.column(c) for c in range(5))):
                if same.as_py():  # both sides are of one block, whose rows may come in another order when it is gathered twice
                    yi, yv = xi, xv
                width = max([1, *xv.values.value_lengths().to_pylist(), *yv.values.value_lengths().to_pylist()])
                for p, q, sim in _cosine_pairs(_matrix(xv.values, width), _matrix(yv.values, width), threshold, same.as_py(), blank):
                    yield pa.RecordBatch.from_arrays([xi.values.take(pa.array(p)), yi.values.take(pa.array(q)), pa.array(sim)], names=["x", "y", "similarity"])

    kind = df.schema[key].dataType.simpleString()
    found = met.mapInArrow(run, f"x {kind}, y {kind}, similarity double")
    return found.where((F.col("x") != F.col("y")) & (F.col("similarity") >= threshold)).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def similar_links(df: DataFrame, threshold: float, key: str, column: str, shard: str | Sequence[str] | None = None) -> DataFrame:
    """(a, b): links with the components of similar_pairs; equal vectors of a shard are linked to the first of them, which alone is compared."""
    rows, by = _sharded(df, column, shard)
    rows = rows.select(*by, key, column)
    firsts = stage(rows.groupBy(*by, column).agg(F.min(key).alias("a")), "firsts")
    finite = F.forall(column, lambda x: F.abs(x) < float("inf"))
    own = F.when(F.forall(column, lambda x: x == 0), 0.0).when(finite, 1.0).otherwise(float("nan"))  # of a vector with itself
    alike = rows.join(firsts, [*by, column]).where((F.col(key) != F.col("a")) & (own >= threshold))
    return similar_pairs(firsts.withColumnRenamed("a", key), threshold, key, column, shard).select("a", "b").union(alike.select("a", F.col(key).alias("b")))


def representatives(df: DataFrame, pairs: DataFrame, key: str, policy: Sequence[Column]) -> DataFrame:
    """(key, group, kept): groups are the components of the pairs; of each the first row by the policy is kept."""
    groups = components(pairs.select("a", "b"))
    rows = df.join(groups.withColumnRenamed("node", key), key, "left").withColumn("group", F.coalesce("component", key))
    first = F.row_number().over(Window.partitionBy("group").orderBy(*policy, key)) == 1
    return rows.select(key, "group", first.alias("kept"))


def stratified(df: DataFrame, by: Sequence[str], n: int, order: Sequence[str]) -> DataFrame:
    """At most n rows of each slice, the first in a fixed order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def farthest_first(df: DataFrame, n: int, key: str, column: str) -> DataFrame:
    """(key, position, distance): a k-centre sample; starts at the smallest key, then each time the row farthest from those taken, ties to the smaller key.

    n rounds, each a map over the rows and a map-side-combined maximum; n is the sample's size, not the input's."""
    rows = df.where(F.col(column).isNotNull()).select(key, F.col(column).cast("array<double>").alias("v"))
    first = rows.orderBy(key).first()
    if first is None:
        return rows.select(key, F.lit(0).alias("position"), F.lit(0.0).alias("distance")).limit(0)
    taken, picks = [first], [(first[0], 0, 0.0)]
    while len(picks) < n:
        d = F.array_min(F.array(*[fn.l2_distance(F.col("v"), F.array(*map(F.lit, t[1]))) for t in taken]))
        best = rows.where(~F.col(key).isin([t[0] for t in taken])).select(d.alias("d"), key, "v").agg(F.max(F.struct(F.round("d", 9), -F.col(key), "v")).alias("b")).first().b
        if best is None:
            break
        pick = (-best[1], list(best[2]))
        taken.append(pick)
        picks.append((pick[0], len(picks), float(best[0])))
    return df.sparkSession.createDataFrame(picks, f"{key} {df.schema[key].dataType.simpleString()}, position int, distance double")


def similar_to_seed(df: DataFrame, seed: Sequence[float], limit: int, key: str, column: str) -> DataFrame:
    """(key, similarity): the rows most like a seed vector."""
    q = F.array(*[F.lit(float(x)) for x in seed])
    return df.where(F.col(column).isNotNull()).select(key, fn.cosine(F.col(column), q).alias("similarity")).orderBy(F.desc(F.round("similarity", 9)), key).limit(limit)


def review_queue(scored: DataFrame, limit: int, key: str, score: str, group: str | None = None, per_group: int = 1) -> DataFrame:
    """(key, score, rank): by falling score, at most per_group rows of a duplicate group."""
    rows = scored
    if group:
        rows = rows.withColumn("__g", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), key))).where(F.col("__g") <= per_group)
    top = rows.orderBy(F.desc(score), key).limit(limit)
    return top.select(key, score, F.row_number().over(Window.orderBy(F.desc(score), key)).alias("rank"))


def row_plan(scenarios: DataFrame, members: DataFrame, decisions: DataFrame, scenario: str, row: str) -> DataFrame:
    """(scenario, row): rows of surviving scenarios minus row excludes; if any row is included by decision, only such rows.

    decisions: (grain, id, decision). A row's include wins over its scenario's exclude."""
    d = decisions.withColumn("yes", F.col("decision").isin("include", "promote"))
    s = d.where("grain = 'scenario'").select(F.col("id").alias(scenario), F.col("yes").alias("s_yes"))
    r = d.where("grain = 'row'").select(F.col("id").alias(row), F.col("yes").alias("r_yes"))
    only = r.agg(F.coalesce(F.bool_or("r_yes"), F.lit(False)).alias("only"))  # one row
    every = members.join(scenarios.select(scenario).distinct(), scenario, "left_semi").join(s, scenario, "left").join(r, row, "left").crossJoin(F.broadcast(only))
    keep = F.when(F.col("only"), F.coalesce("r_yes", F.lit(False))).otherwise(F.coalesce("s_yes", F.lit(True)) & F.coalesce("r_yes", F.lit(True)))
    return every.where(keep).select(scenario, row)


def from_gaps(df: DataFrame, gaps: DataFrame, label: str, order: Sequence[str], per_gap: int) -> DataFrame:
    """Candidates of deficit slices, as many as are needed and no more than per_gap."""
    need = gaps.where("needed > 0").select(label, F.least("needed", F.lit(per_gap)).alias("__n"))
    return df.join(need, label).withColumn("__r", F.row_number().over(Window.partitionBy(label).orderBy(*order))).where("__r <= __n").drop("__r", "__n")


def regressions(metrics: DataFrame, key: Sequence[str], run: str, score: str, baseline: str, candidate: str, threshold: float) -> DataFrame:
    """Metrics of a candidate run that fell below the baseline's by more than the threshold."""
    both = metrics.where(F.col(run).isin(baseline, candidate)).groupBy(*key).agg(F.max(F.when(F.col(run) == baseline, F.col(score))).alias("base"), F.max(F.when(F.col(run) == candidate, F.col(score))).alias("now"))
    return both.where(F.col("now") < F.col("base") - threshold)


# Scorers: Column builders over a row with `score`, `kind` and a map of numeric metadata.


def calibrated(score: Column, kind: Column, scale: float = 1.0) -> Column:
    clamp = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return F.when(kind == "confidence", 1 - clamp).when(kind == "probability", 1 - F.abs(2 * score - 1)).when(kind == "loss", score / scale).otherwise(score)


def uncertainty(score: Column, kind: Column, meta: Column, has_labels: Column) -> Column:
    """The largest of the calibrated score, the metadata's uncertainty measures, and 1 where labels are missing."""
    return F.greatest(calibrated(score, kind), *[meta[k] for k in ("uncertainty", "entropy", "loss", "disagreement")], F.when(~has_labels, F.lit(1.0)))


def confidence_margin(score: Column, kind: Column, cap: float) -> Column:
    c = calibrated(score, kind)
    return F.when(c <= cap, c)


def metadata_score(metadata: Column, name: str) -> Column:
    """entropy or high loss: the greatest finite value that a list of metadata maps has under a name; null without any."""
    values = F.transform(metadata, lambda m: m[name].cast("double"))
    return F.array_max(F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def ensemble_disagreement(members: Column, variance: bool = False) -> Column:
    """Range or population variance of at least two members' scores."""
    mean = F.aggregate(members, F.lit(0.0), lambda s, x: s + x) / F.size(members)
    spread = F.aggregate(members, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(members) if variance else F.array_max(members) - F.array_min(members)
    return F.when(F.size(members) >= 2, spread)


def missing_labels(have: Column, required: Sequence[str], weight: float = 1.0, graded: bool = True) -> Column:
    gone = F.size(F.array_except(F.array(*map(F.lit, required)), have))
    return F.when(gone > 0, weight * (gone / len(required) if graded else 1.0))


def failure_severity(kind: Column, impact: Column, severities: Mapping[str, float]) -> Column:
    """The kind's severity, or a larger numeric impact."""
    named = F.create_map(*[F.lit(x) for kv in severities.items() for x in kv])
    return F.greatest(named[kind], impact)


def gap_boost(needed: Column, target: Column, boost: float) -> Column:
    return F.when(needed > 0, F.when(target > 0, boost * F.least(F.lit(1.0), needed / target)).otherwise(boost))


def label_cost(cost: Column, weight: float) -> Column:
    return -weight * cost


def composite(parts: Sequence[tuple[Column, float]], how: str = "sum") -> Column:
    """Weighted sum or maximum of the scorers that give a score; null if none does."""
    weighted = F.filter(F.array(*[c * w for c, w in parts]), lambda x: x.isNotNull())
    total = F.aggregate(weighted, F.lit(0.0), lambda s, x: s + x) if how == "sum" else F.array_max(weighted)
    return F.when(F.size(weighted) > 0, total)


SCORERS = {"uncertainty": uncertainty, "confidence-margin": confidence_margin, "ensemble-disagreement": ensemble_disagreement, "missing-labels": missing_labels, "failure-severity": failure_severity, "distribution-gap-boost": gap_boost, "label-cost": label_cost, "composite": composite}


def register_scorer(name: str, builder) -> None:
    if name in SCORERS:
        raise ValueError(f"scorer {name!r} exists")
    SCORERS[name] = builder


def resolve_scorer(name: str):
    if name not in SCORERS:
        raise KeyError(f"no scorer {name!r}; there are {', '.join(sorted(SCORERS))}")
    return SCORERS[name]


def best_output(df: DataFrame, key: str, score: Column, row_id: str) -> DataFrame:
    """(key, priority, row_id) of each key's highest score, ties to the smallest id."""
    rows = df.select(key, F.col(row_id), score.alias("priority")).where("priority is not null")
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("priority"), row_id))).where("__r = 1").drop("__r")
