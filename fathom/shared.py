"""The folder that all executors share, and tables staged there: lineage ends, sizes are known, a lost executor costs its running tasks only."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Where the paths of staged tables are noted, so that a caller may drop those that its own calls have left; see staged_here.
_NOTED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, one of our own if all run on this machine, else an error."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "/tmp/checkpoints/fathom"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staging_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    if (noted := _NOTED.get()) is not None:
        noted.append(path)
    return path


def stage(df: DataFrame, tag: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there, sizes are known, lost executors cost nothing."""
    spark = df.sparkSession
    path = staging_path(spark, tag)
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def unstage(*tables: DataFrame) -> None:
    """Drop staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_staged_at", None):
            drop_staged(df.sparkSession, [path])


@contextmanager
def staged_here() -> Iterator[list[str]]:
    """The paths that calls inside stage and leave behind, for drop_staged; those of other callers are not among them."""
    mine: list[str] = []
    token = _NOTED.set(mine)
    try:
        yield mine
    finally:
        _NOTED.reset(token)
        if (outer := _NOTED.get()) is not None:
            outer += mine


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    noted = _NOTED.get()
    for path in list(paths):
        delete_path(spark, path)
        if noted is not None and path in noted:
            noted.remove(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows for what is run inside: where a row holds a text or a set, a default batch of 10,000 takes far more memory than its work."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
