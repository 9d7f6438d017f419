"""The lineage store: artifacts and edges projected from tables, handles resolved, checkpoints traced to their sources, evidence packed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import digest
from .graph import reach


def artifacts(tables: Mapping[str, tuple[DataFrame, str, str | None]]) -> DataFrame:
    """(artifact_id, kind, ref, name): a row for each row of the tables, {kind: (table, key, name column)}; the id is kind:key."""
    out = None
    for kind, (df, key, name) in tables.items():
        part = df.select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("artifact_id"), F.lit(kind).alias("kind"), F.col(key).cast("string").alias("ref"), (F.col(name).cast("string") if name else F.lit(None).cast("string")).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out.where("ref is not null").distinct()


def edges(links: Sequence[tuple[DataFrame, str, str, str, str, str]]) -> DataFrame:
    """(edge_id, type, src, dst) of foreign keys: (table, type, source kind, source key, target kind, target key)."""
    out = None
    for df, kind, sk, sc, dk, dc in links:
        part = df.where(F.col(sc).isNotNull() & F.col(dc).isNotNull()).select(F.lit(kind).alias("type"), F.concat(F.lit(f"{sk}:"), F.col(sc).cast("string")).alias("src"), F.concat(F.lit(f"{dk}:"), F.col(dc).cast("string")).alias("dst"))
        out = part if out is None else out.unionByName(part)
    return out.distinct().withColumn("edge_id", digest("type", "src", "dst", prefix="edge-"))


def refresh(known: DataFrame, fresh: DataFrame, held: DataFrame | None = None, key: str = "edge_id") -> DataFrame:
    """(key, action) that brings a stored projection up to date: insert, keep, or delete; what is held stays though it is stale. Doing it twice changes nothing."""
    k, f = known.select(key, F.lit(True).alias("k")), fresh.select(key, F.lit(True).alias("f"))
    both = f.join(k, key, "full")
    if held is not None:
        both = both.join(held.select(key, F.lit(True).alias("h")).distinct(), key, "left")
    else:
        both = both.withColumn("h", F.lit(None).cast("boolean"))
    action = F.when(F.col("k").isNull(), "insert").when(F.col("f").isNotNull(), "keep").when(F.col("h"), "held").otherwise("delete")
    return both.select(key, action.alias("action"))


def needs_refresh(watermark: Mapping[str, int] | None, versions: Mapping[str, int]) -> bool:
    """False if all sources are of the versions of the last refresh."""
    return dict(watermark or {}) != dict(versions)


def resolve(handles: DataFrame, known: DataFrame, handle: str = "handle") -> DataFrame:
    """(handle, artifact_id, how, candidates): each handle as an artifact id, a reference or a name, in this order; ambiguous ones get no id but the number of candidates."""
    ways = [("artifact_id", "id"), ("ref", "ref"), ("name", "name")]
    keys = None
    for rank, (c, how) in enumerate(ways):
        part = known.where(F.col(c).isNotNull()).select(F.col(c).alias("k"), F.lit(rank).alias("rank"), F.lit(how).alias("how"), "artifact_id")
        keys = part if keys is None else keys.unionByName(part)
    hits = handles.select(handle).distinct().join(keys, F.col(handle) == F.col("k"), "left")
    best = hits.groupBy(handle, "rank", "how").agg(F.min("artifact_id").alias("first"), F.count_distinct("artifact_id").alias("n")).groupBy(handle).agg(F.min(F.struct("rank", "how", "first", "n")).alias("b"))
    n = F.coalesce("b.n", F.lit(0))
    return best.select(handle, F.when(n == 1, F.col("b.first")).alias("artifact_id"), F.when(n == 0, "unknown").when(n > 1, "ambiguous").otherwise(F.col("b.how")).alias("how"), n.alias("candidates"))


def trace_checkpoint(checkpoint: DataFrame, members: DataFrame, rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(checkpoint_id, snapshot_id, row_id, source_uri, at): from a checkpoint to its snapshot, the snapshot's rows, and their coordinates in the source logs.

    checkpoint (checkpoint_id, snapshot_id), members (snapshot_id, row_id), rows (row_id, run_id, at), sources (run_id, source_uri); rows that are gone keep their id with nulls."""
    return checkpoint.join(members, "snapshot_id").join(rows, "row_id", "left").join(sources, "run_id", "left").select("checkpoint_id", "snapshot_id", "row_id", "source_uri", "at")


def downstream(outputs: DataFrame, labels: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(run_id, scenario_id, kind, ref): what hangs on a run: labels and model outputs of its scenarios."""
    both = outputs.select("scenario_id", F.lit("output").alias("kind"), F.col("output_id").cast("string").alias("ref")).unionByName(labels.select("scenario_id", F.lit("label").alias("kind"), F.col("label_id").cast("string").alias("ref")))
    return scenarios.select("scenario_id", "run_id").join(both, "scenario_id").select("run_id", "scenario_id", "kind", "ref")


def evidence_pack(graph: DataFrame, roots: DataFrame, known: DataFrame, direction: str = "up") -> DataFrame:
    """(node, depth, kind, name, pack_id): what a trace from the roots reaches, under an id that is a digest of all of it."""
    found = reach(graph, roots, direction).join(known.select(F.col("artifact_id").alias("node"), "kind", "name"), "node", "left")
    sums = found.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("node", "depth"), F.lit(1_000_000_007))).alias("s"), F.sum(F.pmod(F.xxhash64(F.lit(1), "node", "depth"), F.lit(998_244_353))).alias("t"))
    ident = sums.select(F.concat(F.lit("pack-"), F.substring(F.sha1(F.concat_ws("|", "n", "s", "t").cast("binary")), 1, 16)).alias("pack_id"))
    return found.crossJoin(F.broadcast(ident))
