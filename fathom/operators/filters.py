"""Filters, precedence joins, set operations and redaction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(filters: Mapping[str, object]) -> Column:
    """Equality for scalars (null equals null), membership for lists; all must hold. Pushed down by Catalyst where it can be."""
    out = F.lit(True)
    for name, want in filters.items():
        c = F.col(name)
        if isinstance(want, (list, tuple, set, frozenset)):
            known = [w for w in want if w is not None]
            hit = c.isin(*known) if known else F.lit(False)
            out = out & (hit | c.isNull() if None in want else F.coalesce(hit, F.lit(False)))
        else:
            out = out & c.eqNullSafe(F.lit(want))
    return out


def quality_filter(df: DataFrame, score: str, least: float, flags: str | None = None, include: Sequence[str] = (), exclude: Sequence[str] = ("quarantined",)) -> DataFrame:
    """Rows of enough quality that carry all `include` flags and none of `exclude`."""
    out = df.where(F.col(score) >= least)
    if flags:
        have = F.coalesce(F.col(flags), F.array().cast("array<string>"))
        for f in include:
            out = out.where(F.array_contains(have, f))
        if exclude:
            out = out.where(~F.arrays_overlap(have, F.array(*map(F.lit, exclude))))
    return out


def quarantined(df: DataFrame, run: str, flags: str) -> DataFrame:
    return df.where(F.array_contains(flags, "quarantined")).select(run).distinct()


def missing_ids(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    return ids.select(key).distinct().join(table.select(key), key, "left_anti")


def resolve_by_precedence(rows: DataFrame, tables: Sequence[tuple[str, DataFrame, str]], out: str) -> DataFrame:
    """The first target found: tables are (key of the row, table with that key, its target column) in order of precedence; dangling rows get null."""
    cols = []
    for i, (key, t, target) in enumerate(tables):
        side = t.select(F.col(key).alias(f"__k{i}"), F.col(target).alias(f"__t{i}")).groupBy(f"__k{i}").agg(F.min(f"__t{i}").alias(f"__t{i}"))
        rows = rows.join(side, F.col(key) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        cols.append(f"__t{i}")
    return rows.withColumn(out, F.coalesce(*cols)).drop(*cols)


def override(selected: DataFrame, include: DataFrame, exclude: DataFrame, key: str) -> DataFrame:
    """Automatic selection with decisions applied: plus include, minus exclude."""
    return selected.select(key).union(include.select(key)).distinct().join(exclude.select(key), key, "left_anti")


def sync_states(lake: DataFrame, bundle: DataFrame, key: str, content: str) -> DataFrame:
    """Full outer comparison by content: created, updated, unchanged, or lake_only."""
    l, b = lake.select(F.col(key).alias("__l"), F.col(content).alias("__lc")), bundle.select(F.col(key).alias("__b"), F.col(content).alias("__bc"))
    j = l.join(b, F.col("__l") == F.col("__b"), "full_outer")
    state = F.when(F.col("__l").isNull(), "created").when(F.col("__b").isNull(), "lake_only").when(F.col("__lc").eqNullSafe(F.col("__bc")), "unchanged").otherwise("updated")
    return j.select(F.coalesce("__l", "__b").alias(key), state.alias("state"))


def reconcile(old: DataFrame, new: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Divergence both ways: stale rows (materialised, no longer projected, not held) and missing ones."""
    stale = old.select(key).join(new.select(key), key, "left_anti").join(held.select(key), key, "left_anti").withColumn("state", F.lit("stale"))
    return stale.union(new.select(key).join(old.select(key), key, "left_anti").withColumn("state", F.lit("missing")))


def redact(df: DataFrame, allow: Sequence[str], hashed: Mapping[str, str] | None = None) -> DataFrame:
    """Only allowed columns, and SHA-256 digests of others under new names."""
    return df.select(*allow, *[F.sha2(F.coalesce(F.col(c).cast("string"), F.lit("")), 256).alias(n) for c, n in (hashed or {}).items()])
