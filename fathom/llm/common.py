"""Shared pieces of the operators: staged tables in the shared folder, splits, names of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from ..shared import delete_path, drop_staged, shared_root, stage, staged_here, staging_path, unstage

__all__ = ["col", "connected_components", "crc_bucket", "delete_path", "drop_staged", "shared_root", "stage", "staged_here", "staging_path", "unstage", "unused"]


def crc_bucket(column: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids hash as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def col(name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(name: str, *tables: DataFrame) -> str:
    """The name, with as many underscores after it as no column of the tables has."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable. Nodes without an edge are not returned."""
    return components(edges)
