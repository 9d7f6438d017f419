"""Jobs that can be resumed: a column computed part by part, each part written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.lake import Files


class ColumnJob:
    """A column for the rows of a table (embeddings, captions), by parts of a hash of the key. A part that is written is not computed again; a job that broke off
    goes on with what is missing.

    compute takes a DataFrame of rows and gives (key, column)."""

    def __init__(self, df: DataFrame, root: str, key: str, compute: Callable[[DataFrame], DataFrame], parts: int = 16):
        self.df, self.root, self.key, self.compute, self.parts = df, root.rstrip("/"), key, compute, parts
        self.files = Files(df.sparkSession, root)

    def done(self) -> set[int]:
        return {int(n[5:]) for n in self.files.names(self.root) if n.startswith("part=") and "_SUCCESS" in self.files.names(f"{self.root}/{n}")}

    def run(self, most: int | None = None) -> int:
        """Work on missing parts, at most so many; how many are left."""
        todo = [p for p in range(self.parts) if p not in self.done()]
        for p in todo[:most]:
            rows = self.df.where(F.pmod(F.xxhash64(self.key), F.lit(self.parts)) == p)
            self.compute(rows).write.mode("overwrite").parquet(f"{self.root}/part={p}")
        return len(todo[most:]) if most is not None else 0

    def result(self) -> DataFrame:
        missing = self.parts - len(self.done())
        if missing:
            raise RuntimeError(f"{missing} of {self.parts} parts are missing; run the job under {self.root} again")
        return self.df.sparkSession.read.parquet(*[f"{self.root}/part={p}" for p in range(self.parts)])
