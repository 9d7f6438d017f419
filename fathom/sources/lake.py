"""A small versioned lake of Parquet tables: immutable parts, one manifest file per version, tags, upserts, snapshots.

Layout: <root>/<table>/parts/<id>/ holds Parquet files, <root>/<table>/versions/<n>.json lists the parts of version n.
A commit writes its parts, then creates the next manifest exclusively through the Hadoop file system, which fails if
another writer was first. An append is then tried on the new version as it is; a write that was computed from the old
version (upsert, delete, a new column, compaction) is computed again from the new one, so no commit is ever lost. The store must
create files exclusively (HDFS, ABFS, GCS and local disks do, S3A with conditional writes). Readers see whole versions only; reading
an old one is reading its list. No state is kept on any machine.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class LakeError(Exception):
    pass


class Files:
    """The Hadoop file system of a path, as far as the lake needs it."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark.sparkContext._jvm
        self.Path = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, path: str) -> list[str]:
        p = self.Path(path)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(p)) if self.fs.exists(p) else []

    def read(self, path: str) -> str:
        stream = self.fs.open(self.Path(path))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str, replace: bool = False) -> bool:
        """False if the file is there already and may not be replaced."""
        try:
            out = self.fs.create(self.Path(path), replace)
        except Exception as e:  # noqa: BLE001  the JVM's exists-already error has several names
            if "exist" in str(e).lower():
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def delete(self, path: str) -> None:
        self.fs.delete(self.Path(path), True)


class Lake:
    """Tables under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _at(self, name: str, *rest: str) -> str:
        return "/".join([self.root, name, *rest])

    def versions(self, name: str) -> list[int]:
        return sorted(int(f[:-5]) for f in self.files.names(self._at(name, "versions")) if f.endswith(".json") and f[:-5].isdigit())

    def manifest(self, name: str, version: int | str | None = None) -> dict:
        if isinstance(version, str):
            tag = self._at(name, "tags", f"{version}.json")
            if f"{version}.json" not in self.files.names(self._at(name, "tags")):
                raise LakeError(f"{name} has no tag {version!r}")
            version = json.loads(self.files.read(tag))["version"]
        have = self.versions(name)
        if not have:
            raise LakeError(f"there is no table {name!r}")
        version = have[-1] if version is None else version
        if version not in have:
            raise LakeError(f"{name} has no version {version}")
        return json.loads(self.files.read(self._at(name, "versions", f"{version}.json"))) | {"version": version}

    def table(self, name: str, version: int | str | None = None) -> DataFrame:
        """The newest, a numbered or a tagged version."""
        m = self.manifest(name, version)
        schema = T.StructType.fromJson(m["schema"])
        if not m["parts"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self._at(name, "parts", p) for p in m["parts"]])

    def _put(self, name: str, version: int, parts: list[str], schema: T.StructType) -> bool:
        return self.files.create(self._at(name, "versions", f"{version}.json"), json.dumps({"parts": parts, "schema": schema.jsonValue()}))

    def _add(self, name: str, df: DataFrame, tries: int = 20) -> int:
        """A part added to whatever version is the newest."""
        part = uuid.uuid4().hex
        df.write.parquet(self._at(name, "parts", part))
        for _ in range(tries):
            m = self.manifest(name)
            if T.StructType.fromJson(m["schema"]) != df.schema and [(f.name, f.dataType) for f in T.StructType.fromJson(m["schema"])] != [(f.name, f.dataType) for f in df.schema]:
                raise LakeError(f"{name}: another writer changed the schema")
            if self._put(name, m["version"] + 1, [*m["parts"], part], T.StructType.fromJson(m["schema"])):
                return m["version"] + 1
        raise LakeError(f"{name}: other writers committed {tries} times in between")

    def _replace(self, name: str, build, tries: int = 5) -> int:
        """A version computed from the newest one, computed again if that has moved by the time it is committed."""
        for _ in range(tries):
            base, part = self.manifest(name)["version"], uuid.uuid4().hex
            df = build(self.table(name, base))
            df.write.parquet(self._at(name, "parts", part))
            if self._put(name, base + 1, [part], df.schema):
                return base + 1
            self.files.delete(self._at(name, "parts", part))
        raise LakeError(f"{name}: other writers committed {tries} times in between")

    def _checked(self, name: str, df: DataFrame) -> DataFrame:
        want = T.StructType.fromJson(self.manifest(name)["schema"])
        if sorted(df.columns) != sorted(want.names) or any(df.schema[f.name].dataType != f.dataType for f in want):
            raise LakeError(f"{name}: the schema differs: {df.schema.simpleString()} for {want.simpleString()}")
        return df.select(want.names)

    def create(self, name: str, df: DataFrame) -> int:
        part = uuid.uuid4().hex
        if not self.versions(name):
            df.write.parquet(self._at(name, "parts", part))
            if self._put(name, 1, [part], df.schema):
                return 1
            self.files.delete(self._at(name, "parts", part))
        raise LakeError(f"{name} exists")

    def append(self, name: str, df: DataFrame) -> int:
        return self._add(name, self._checked(name, df))

    def overwrite(self, name: str, df: DataFrame) -> int:
        return self._replace(name, lambda old: df)

    def upsert(self, name: str, df: DataFrame, key: str | Sequence[str]) -> int:
        """Rows of known keys are replaced, others added; of several rows with one key the greatest counts."""
        keys = [key] if isinstance(key, str) else list(key)
        new = self._checked(name, df)
        rest = [c for c in new.columns if c not in keys]
        one = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("r")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]).select(new.columns) if rest else new.distinct()
        return self._replace(name, lambda old: old.join(one.select(*keys), keys, "left_anti").select(new.columns).unionByName(one))

    def replace_by(self, name: str, df: DataFrame, key: str | Sequence[str]) -> int:
        """All rows of the new rows' keys are replaced by the new rows, in one version."""
        keys = [key] if isinstance(key, str) else list(key)
        new = self._checked(name, df)
        return self._replace(name, lambda old: old.join(new.select(*keys).distinct(), keys, "left_anti").select(new.columns).unionByName(new))

    def delete(self, name: str, condition: str) -> int:
        return self._replace(name, lambda old: old.where(f"not coalesce({condition}, false)"))

    def add_column(self, name: str, updates: DataFrame, key: str, column: str) -> int:
        """A column from a table of updates; rows without one keep their value, or null."""

        def build(base):
            side = updates.select(F.col(key).alias("__k"), F.col(column).alias("__v"))
            old = F.col(column) if column in base.columns else F.lit(None).cast(updates.schema[column].dataType)
            out = base.join(side, base[key] == F.col("__k"), "left").withColumn("__new", F.coalesce("__v", old)).drop("__k", "__v", *([column] if column in base.columns else []))
            return out.withColumnRenamed("__new", column)

        return self._replace(name, build)

    def tag(self, name: str, tag: str, version: int | None = None) -> None:
        self.files.create(self._at(name, "tags", f"{tag}.json"), json.dumps({"version": self.manifest(name, version)["version"]}), replace=True)

    def compact(self, name: str, files: int = 8) -> int:
        return self._replace(name, lambda old: old.coalesce(files))

    def maintain(self, name: str, pins: Sequence[int] = (), files: int = 8, keep: int = 1) -> list[int]:
        """Tag the pinned versions first, then compact, then drop what is neither tagged nor among the last. The versions dropped."""
        for v in pins:
            self.tag(name, f"pin-{v}", v)
        self.compact(name, files)
        return self.prune(name, keep)

    def prune(self, name: str, keep: int = 1) -> list[int]:
        """Drop all but the last `keep` versions and the tagged ones, and the parts that only they had."""
        have = self.versions(name)
        pinned = {json.loads(self.files.read(self._at(name, "tags", t)))["version"] for t in self.files.names(self._at(name, "tags"))}
        gone = [v for v in have[:-keep] if v not in pinned]
        left = {p for v in have if v not in gone for p in self.manifest(name, v)["parts"]}
        for v in gone:
            for p in self.manifest(name, v)["parts"]:
                if p not in left:
                    self.files.delete(self._at(name, "parts", p))
        for v in gone:
            self.files.delete(self._at(name, "versions", f"{v}.json"))
        return gone

    def take(self, name: str, ids: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
        """Rows by id, as a semi-join; payload columns are read for their files only if asked for."""
        rows = self.table(name).join(ids.select(key).distinct(), key, "left_semi")
        return rows.select(*columns) if columns else rows

    def snapshot(self, name: str, ids: DataFrame, key: str, ratios: dict[str, float]) -> DataFrame:
        """(key, split, snapshot_id): distinct ids, refused if unknown to the table, split by a hash, under a content-addressed id."""
        from ..functions.scalars import hash_split

        chosen = ids.select(key).distinct()
        unknown = chosen.join(self.table(name).select(key), key, "left_anti").limit(3).collect()
        if unknown:
            raise LakeError(f"ids that {name} doesn't have: {[r[0] for r in unknown]}")
        what = json.dumps({"ratios": ratios, "table": name, "version": self.manifest(name)["version"]}, sort_keys=True)
        sums = chosen.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key) % 1000000007).alias("s"), F.sum(F.xxhash64(F.lit(1), key) % 998244353).alias("t"))
        ident = F.concat(F.lit("ds-"), F.substring(F.sha1(F.concat_ws("|", F.lit(what), "n", "s", "t").cast("binary")), 1, 16))
        return chosen.withColumn("split", hash_split(key, ratios)).crossJoin(F.broadcast(sums.select(ident.alias("snapshot_id"))))
