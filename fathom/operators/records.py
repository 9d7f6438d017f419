"""Governed records: manifests, catalogs and write-backs. All are tables with keys, pages, protection and retention."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeline import latest


def page(df: DataFrame, limit: int, where: Column | None = None, after: tuple | None = None, time: str = "created_at", key: str = "id") -> DataFrame:
    """A page of a filtered list, newest first, past a (time, key) position."""
    rows = df if where is None else df.where(where)
    if after is not None:
        rows = rows.where((F.col(time) < F.lit(after[0])) | ((F.col(time) == F.lit(after[0])) & (F.col(key) > F.lit(after[1]))))
    return rows.orderBy(F.desc(time), key).limit(limit)


def retention(df: DataFrame, group: Sequence[str], keep: int, older_than, time: str = "created_at", key: str = "id", protected: DataFrame | None = None) -> DataFrame:
    """Every row with its verdict: protected, kept (among the newest of its group, or too new), expired."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(time), key))
    rows = df.withColumn("__r", rank)
    if protected is not None:
        rows = rows.join(protected.select(F.col(key).alias("__p")).distinct(), F.col(key) == F.col("__p"), "left")
    else:
        rows = rows.withColumn("__p", F.lit(None))
    verdict = F.when(F.col("__p").isNotNull(), "protected").when((F.col("__r") <= keep) | (F.col(time) >= F.lit(older_than)), "kept").otherwise("expired")
    return rows.withColumn("verdict", verdict).drop("__r", "__p")


def holds(rows: DataFrame, policies: DataFrame, key: str = "id") -> DataFrame:
    """(key, policy, conflict): policies (policy, scope_key, scope_value, action) that apply to a row by any of its `scopes` entries (a map); conflict where hold and expire meet."""
    tags = rows.select(key, F.explode("scopes").alias("scope_key", "scope_value"))
    hit = tags.join(policies, ["scope_key", "scope_value"]).select(key, "policy", "action").distinct()
    acts = hit.groupBy(key).agg(F.count_distinct("action").alias("n"))
    return hit.join(acts, key).select(key, "policy", "action", (F.col("n") > 1).alias("conflict"))


def transitions(log: DataFrame, allowed: dict[str, Sequence[str]], key: str, order: Sequence[str], state: str) -> DataFrame:
    """Each step of a state log with whether it was allowed from the state before; the first must be allowed from ''."""
    prev = F.coalesce(F.lag(state).over(Window.partitionBy(key).orderBy(*order)), F.lit(""))
    ok = F.lit(False)
    for a, bs in allowed.items():
        ok = ok | ((prev == a) & F.col(state).isin(*bs))
    return log.withColumn("previous", prev).withColumn("allowed", ok)


def stale_jobs(jobs: DataFrame, key: str, beat: str, now: int, after: int) -> DataFrame:
    """The last heartbeat of each job that is older than `after`."""
    return latest(jobs, key, [beat]).where(F.lit(now) - F.col(beat) > after)


def write_back(base: DataFrame, rows: DataFrame, key: str, order: Sequence[str], values: dict[str, str]) -> DataFrame:
    """Later rows win: columns of the base taken from the last write-back row of each key, where there is one."""
    last = latest(rows.select(F.col(key).alias("__k"), *order, *[F.col(v).alias(f"__{c}") for c, v in values.items()]), "__k", order).drop(*order)
    out = base.join(last, base[key] == F.col("__k"), "left")
    for c in values:
        out = out.withColumn(c, F.coalesce(F.col(f"__{c}"), F.col(c)) if c in base.columns else F.col(f"__{c}"))
    return out.drop("__k", *[f"__{c}" for c in values])


def conflicts(planned: DataFrame, owned: DataFrame, key: str, owner: str, policy: str = "error") -> DataFrame:
    """Rows that a plan may take: those of other owners are refused (error), left to them (preserve) or taken (replace, supersede)."""
    other = owned.select(F.col(key).alias("__k"), F.col(owner).alias("__o"))
    clash = planned.join(other, (F.col(key) == F.col("__k")) & (F.col(owner) != F.col("__o")), "left_semi")
    if policy in ("replace", "supersede"):
        return planned
    if policy == "preserve":
        return planned.join(clash.select(F.col(key).alias("__c")).distinct(), F.col(key) == F.col("__c"), "left_anti")
    if policy != "error":
        raise ValueError(f"unknown policy {policy!r}")
    some = [r[0] for r in clash.select(key).limit(3).collect()]
    if some:
        raise ValueError(f"rows that belong to others: {some}")
    return planned


PROVIDERS: dict[str, Callable] = {}


def register_provider(name: str, fn: Callable) -> None:
    """A provider maps a pandas Series of texts to a Series of results; it runs in Arrow batches on the executors."""
    PROVIDERS[name] = fn


def enrich(df: DataFrame, done: DataFrame, key: str, source: str, provider: str, column: str, kind: str) -> DataFrame:
    """(key, column) of the rows that aren't enriched yet; refuses a provider that isn't registered."""
    if provider not in PROVIDERS:
        raise KeyError(f"no provider {provider!r}")
    fn = F.pandas_udf(PROVIDERS[provider], kind)
    return df.join(done.select(key), key, "left_anti").select(key, fn(F.col(source)).alias(column))


def fetch_payloads(ids: DataFrame, payloads: DataFrame, key: str) -> DataFrame:
    """Payloads by id, joined last: nothing but the ids wanted reads the payload column."""
    return payloads.join(ids.select(key).distinct(), key, "left_semi")
