"""Readers and writers of outside formats: interval manifests, robot datasets, step episodes, tar shards, MCAP logs, MP4 tables."""

from __future__ import annotations

import io
import struct
import tarfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTERVALS = "run_id string, from_timestamp_ns long, to_timestamp_ns long, external_id string, outcome string, task_id string, tags string, metadata string"


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """An interval manifest, JSON lines or CSV by its name; nothing is inferred."""
    if path.endswith(".csv"):
        return spark.read.schema(INTERVALS).option("header", True).csv(path)
    return spark.read.schema(INTERVALS).json(path)


def check_intervals(intervals: DataFrame, runs: DataFrame, clip: bool = False, allow_empty: bool = False) -> DataFrame:
    """Each interval with the problem that bars it, if any: unknown-run, reversed, out-of-bounds, empty, duplicate-id; clipped to its run if allowed."""
    r = runs.select(F.col("run_id").alias("__r"), F.col("start").alias("__lo"), F.col("end").alias("__hi"))
    j = intervals.join(r, F.col("run_id") == F.col("__r"), "left")
    lo, hi = F.col("from_timestamp_ns"), F.col("to_timestamp_ns")
    if clip:
        j = j.withColumn("from_timestamp_ns", F.greatest(lo, "__lo")).withColumn("to_timestamp_ns", F.least(hi, "__hi"))
    n = F.count("*").over(Window.partitionBy("external_id"))
    problem = F.when(F.col("__r").isNull(), "unknown-run").when(hi < lo, "reversed").when((lo < F.col("__lo")) | (hi > F.col("__hi")), "out-of-bounds")
    if not allow_empty:
        problem = problem.when(hi == lo, "empty")
    return j.withColumn("problem", problem.when(F.col("external_id").isNotNull() & (n > 1), "duplicate-id")).drop("__r", "__lo", "__hi")


def read_records(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Rows of a write-back or tracker bundle: a JSON document with a list under `key`."""
    doc = spark.read.schema(f"`{key}` array<struct<{schema}>>").option("multiLine", True).json(path)
    return doc.select(F.inline(key))


def read_frames(spark: SparkSession, root: str) -> DataFrame:
    """The frames of a robot dataset: data/**/*.parquet under its root, columns as they are."""
    return spark.read.option("recursiveFileLookup", True).parquet(f"{root.rstrip('/')}/data")


def read_info(spark: SparkSession, root: str, schema: str = "fps double, total_episodes long, total_frames long, robot_type string, codebase_version string") -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(f"{root.rstrip('/')}/meta/info.json")


def write_frames(df: DataFrame, root: str, episode: str, frame: str, time: str, fps: float) -> None:
    """A robot dataset: frames by episode under data/, and meta/ with the totals."""
    root = root.rstrip("/")
    df.withColumnsRenamed({episode: "episode_index", frame: "frame_index", time: "timestamp"}).repartitionByRange("episode_index").sortWithinPartitions("episode_index", "frame_index").write.parquet(f"{root}/data/chunk-000")
    eps = df.groupBy(F.col(episode).alias("episode_index")).agg(F.count("*").alias("length"))
    eps.write.json(f"{root}/meta/episodes")
    eps.agg(F.lit(float(fps)).alias("fps"), F.count("*").alias("total_episodes"), F.sum("length").alias("total_frames"), F.lit("v3.0").alias("codebase_version")).coalesce(1).write.json(f"{root}/meta/info.json")


def steps(df: DataFrame, episode: str, frame: str) -> DataFrame:
    """Rows as steps of episodes, with is_first, is_last and is_terminal."""
    w = Window.partitionBy(episode).orderBy(frame)
    last = F.lead(frame).over(w).isNull()
    return df.withColumn("is_first", F.lag(frame).over(w).isNull()).withColumn("is_last", last).withColumn("is_terminal", last)


def write_steps(df: DataFrame, root: str, episode: str, frame: str) -> None:
    steps(df, episode, frame).write.partitionBy(episode).parquet(f"{root.rstrip('/')}/episodes")


def tar_shards(df: DataFrame, key: str, fields: Sequence[str], shard_size: int) -> DataFrame:
    """(shard, n, tar): samples in key order, at most shard_size to a tar, each field a member <key>.<field>. Numbered without a global sort in one task."""
    from ..operators.timeline import global_numbers

    rows = global_numbers(df.select(key, *fields), [key], "at").withColumn("shard", F.floor(F.col("at") / shard_size).cast("long"))

    def pack(pdf):
        import pandas as pd

        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
            for r in pdf.sort_values("at").to_dict("records"):
                for f in fields:
                    v = r[f]
                    data = v if isinstance(v, bytes) else ("" if v is None else str(v)).encode()
                    info = tarfile.TarInfo(f"{r[key]}.{f}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n": [len(pdf)], "tar": [out.getvalue()]})

    return rows.groupBy("shard").applyInPandas(pack, "shard long, n long, tar binary")


def to_lines(df: DataFrame, path: str) -> None:
    """NDJSON export, a JSON object for each row."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def split_recording_gaps(shards: DataFrame, run: str = "run_id", ordinal: str = "ordinal", start: str = "start", end: str = "end", n: str = "n") -> DataFrame:
    """Gap or overlap between consecutive shards of a recording that are readable and not empty; touching ones overlap by 0."""
    w = Window.partitionBy(run).orderBy(ordinal)
    rows = shards.where(F.col(n) > 0).withColumn("__e", F.lag(end).over(w)).where("__e is not null")
    d = F.col(start) - F.col("__e")
    return rows.select(run, ordinal, F.when(d > 0, "gap").otherwise("overlap").alias("kind"), F.abs(d).alias("nanos"))


# MCAP logs, read with the standard library alone.

MCAP_MAGIC = b"\x89MCAP0\r\n"
MESSAGES = T.StructType([
    T.StructField("path", T.StringType()), T.StructField("topic", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("schema", T.StringType()), T.StructField("sequence", T.LongType()), T.StructField("log_time", T.LongType()),
    T.StructField("publish_time", T.LongType()), T.StructField("data", T.BinaryType()), T.StructField("status", T.StringType()),
])


def mcap_records(data: bytes, at: int = 0):
    """(opcode, body) of each whole record; stops at the first that is cut off."""
    while at + 9 <= len(data):
        op, n = data[at], struct.unpack_from("<Q", data, at + 1)[0]
        at += 9
        if at + n > len(data):
            return
        yield op, data[at : at + n]
        at += n


def _text(b: bytes, at: int) -> tuple[str, int]:
    n = struct.unpack_from("<I", b, at)[0]
    return b[at + 4 : at + 4 + n].decode("utf-8", "replace"), at + 4 + n


class UnknownCodec(ValueError):
    pass


def _unpacked(kind: str, body: bytes, size: int) -> bytes:
    """A chunk's records. UnknownCodec for a compression that there is no reader for, another ValueError for damage."""
    try:
        if kind == "zstd":
            import zstandard

            return zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
        if kind == "lz4":
            import pyarrow as pa

            return pa.Codec("lz4").decompress(body, decompressed_size=size).to_pybytes()
    except Exception as e:  # noqa: BLE001  each library has errors of its own
        raise ValueError(f"a damaged {kind} chunk") from e
    if kind:
        raise UnknownCodec(f"no reader for chunks in {kind}")
    return body


def mcap_items(data: bytes, check: bool = True):
    """What a log holds, in file order, as (what, fields): schema, channel, message, attachment, metadata, statistics, and damage where a part can't be read.

    Damage names its kind and place: crc (a chunk whose checksum differs, if `check`), chunk (one that can't be unpacked), codec (one in a compression without a
    reader), record (one that is shorter than its fields), cut (the file ends within a record). All that stands before and after is told."""
    import zlib

    if not data.startswith(MCAP_MAGIC):
        raise ValueError("not an MCAP file")

    def walk(raw: bytes, at: int, offset: int):
        while at + 9 <= len(raw):
            op, n = raw[at], struct.unpack_from("<Q", raw, at + 1)[0]
            b, here = raw[at + 9 : at + 9 + n], offset + at
            if len(b) < n:
                yield "damage", {"kind": "cut", "at": here}
                return
            at += 9 + n
            try:
                if op == 0x03:
                    name, i = _text(b, 2)
                    yield "schema", {"id": struct.unpack_from("<H", b)[0], "name": name, "encoding": _text(b, i)[0]}
                elif op == 0x04:
                    cid, sid = struct.unpack_from("<HH", b)
                    topic, i = _text(b, 4)
                    yield "channel", {"id": cid, "schema": sid, "topic": topic, "encoding": _text(b, i)[0]}
                elif op == 0x05:
                    cid, seq, log, pub = struct.unpack_from("<HIQQ", b)
                    yield "message", {"channel": cid, "sequence": seq, "log_time": log, "publish_time": pub, "data": b[22:]}
                elif op == 0x06:
                    size, crc = struct.unpack_from("<QI", b, 16)
                    kind, i = _text(b, 28)
                    body = b[i + 8 : i + 8 + struct.unpack_from("<Q", b, i)[0]]
                    try:
                        body = _unpacked(kind, body, size)
                    except UnknownCodec:
                        yield "damage", {"kind": "codec", "at": here}
                        continue
                    except ValueError:
                        yield "damage", {"kind": "chunk", "at": here}
                        continue
                    if check and crc and zlib.crc32(body) != crc:
                        yield "damage", {"kind": "crc", "at": here}
                        continue
                    yield from walk(body, 0, here)
                elif op == 0x09:
                    log, made = struct.unpack_from("<QQ", b)
                    name, i = _text(b, 16)
                    media, i = _text(b, i)
                    n = struct.unpack_from("<Q", b, i)[0]
                    yield "attachment", {"log_time": log, "create_time": made, "name": name, "media_type": media, "data": b[i + 8 : i + 8 + n]}
                elif op == 0x0C:
                    name, i = _text(b, 0)
                    end, pairs = i + 4 + struct.unpack_from("<I", b, i)[0], {}
                    i += 4
                    while i < end:
                        k, i = _text(b, i)
                        pairs[k], i = _text(b, i)
                    yield "metadata", {"name": name, "pairs": pairs}
                elif op == 0x0F:
                    return  # the data section ends; what follows repeats it
            except struct.error:
                yield "damage", {"kind": "record", "at": here}
        if 0 < len(raw) - at < 9 and raw[at:] != MCAP_MAGIC[: len(raw) - at]:
            yield "damage", {"kind": "cut", "at": offset + at}

    yield from walk(data, len(MCAP_MAGIC), 0)


def mcap_messages(data: bytes, check: bool = True):
    """Messages of a log in file order: (topic, encoding, schema, sequence, log time, publish time, data, status); damage is a row of its own, status damaged:<kind>."""
    schemas, channels = {}, {}
    for what, x in mcap_items(data, check):
        if what == "schema":
            schemas[x["id"]] = x["name"]
        elif what == "channel":
            channels[x["id"]] = x
        elif what == "message":
            c = channels.get(x["channel"], {"topic": "", "encoding": "", "schema": 0})
            yield c["topic"], c["encoding"], schemas.get(c["schema"], ""), x["sequence"], x["log_time"], x["publish_time"], x["data"], "raw"
        elif what == "damage":
            yield None, None, None, None, None, None, None, f"damaged:{x['kind']}"


def _mcap_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mcap").load(path).select("path", "content")


def _per_file(files: DataFrame, schema: T.StructType, rows_of) -> DataFrame:
    """Rows that rows_of(content) yields for each file, with its path, in batches of at most 4,096; a ValueError ends the file with a row that has but the status failed."""

    def run(batches):
        from itertools import islice

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(schema)
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1)):

                def safely():
                    try:
                        yield from rows_of(c.as_py())  # noqa: B023  used up before the next file
                    except ValueError:
                        yield {"status": "failed"}

                rows = safely()
                while part := list(islice(rows, 4096)):
                    yield pa.RecordBatch.from_pylist([{"path": p, **r} for r in part], schema=kind)

    return files.mapInArrow(run, schema)


def read_mcap(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A row for each message of the logs under a path, and one for each damaged part; a file that is no log has a single row of status failed.

    A task reads one file at a time, whole, so a file is limited to 2 GB and to the worker's memory."""
    names = [f.name for f in MESSAGES][1:]
    return _per_file(_mcap_files(spark, path), MESSAGES, lambda data: (dict(zip(names, m)) for m in mcap_messages(data, check)))


def inspect_mcap(spark: SparkSession, path: str) -> DataFrame:
    """(path, topic, schema, encoding, n, first, last, readable, damaged): what each log holds by topic, without taking it in; damaged counts the file's damaged parts."""
    m = read_mcap(spark, path)
    hurt = m.groupBy("path").agg(F.count_if(F.col("status") != "raw").alias("damaged"))
    topics = m.where("status = 'raw'").groupBy("path", "topic", "schema", "encoding").agg(F.count("*").alias("n"), F.min("log_time").alias("first"), F.max("log_time").alias("last"))
    return hurt.join(topics, "path", "left").withColumn("readable", F.coalesce(F.col("encoding").isin("json", "cbor", "msgpack"), F.lit(False)))


EXTRAS = "path string, kind string, log_time long, name string, media_type string, data binary, pairs map<string,string>, status string"


def read_mcap_extras(spark: SparkSession, path: str) -> DataFrame:
    """Attachments and metadata records of the logs under a path; sort by log_time and name for the order that readers expect."""

    def rows(data):
        for what, x in mcap_items(data):
            if what in ("attachment", "metadata"):
                yield {"kind": what, "status": "raw"} | {k: v for k, v in x.items() if k != "create_time"}

    return _per_file(_mcap_files(spark, path), T.StructType.fromDDL(EXTRAS), rows)


def ingest_mcap(lake, path: str, check: bool = True, tables: tuple[str, str, str] = ("sources", "observations", "quarantine")) -> dict:
    """Take the logs under a path into a lake: observations, one row in sources for each log, damage in quarantine. Logs of a content that is there are passed over.

    A log's id is a digest of its bytes. What is readable of a damaged log is kept. Observations go first, keyed by log and place, and are
    replaced by log, so that a run that broke off in between can simply be run again."""
    from ..functions.payloads import decode_payloads

    sources, observations, quarantine = tables
    spark = lake.spark
    files = _mcap_files(spark, path).withColumn("source_id", F.concat(F.lit("log-"), F.substring(F.sha1("content"), 1, 16)))
    first = files.groupBy("source_id").agg(F.min("path").alias("path"))  # copies of a log count once
    if lake.versions(sources):
        first = first.join(lake.table(sources).select("source_id"), "source_id", "left_anti")
    new = {r.path: r.source_id for r in first.collect()}  # a row for each new log
    if not new:
        return {"logs": 0, "messages": 0, "damaged": 0}
    ids = spark.createDataFrame([(p, i) for p, i in new.items()], "path string, source_id string")
    names = [f.name for f in MESSAGES][1:]
    picked = _mcap_files(spark, path).join(F.broadcast(ids.select("path")), "path", "left_semi")
    rows = _per_file(picked, T.StructType([*MESSAGES.fields, T.StructField("place", T.LongType())]), lambda data: ({**dict(zip(names, m)), "place": i} for i, m in enumerate(mcap_messages(data, check))))
    rows = rows.join(F.broadcast(ids), "path")
    good = decode_payloads(rows.where("status = 'raw'").drop("status", "path"))
    hurt = rows.where("status <> 'raw'").select("source_id", "path", F.col("status").alias("reason"))
    for name, df in ((observations, good), (quarantine, hurt)):
        lake.replace_by(name, df, "source_id") if lake.versions(name) else lake.create(name, df)
    counts = lake.table(observations).join(F.broadcast(ids.select("source_id")), "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("n"), F.min("log_time").alias("first"), F.max("log_time").alias("last"))
    bad = lake.table(quarantine).join(F.broadcast(ids.select("source_id")), "source_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("damaged"))
    done = ids.join(counts, "source_id", "left").join(bad, "source_id", "left").select("source_id", "path", F.coalesce("n", F.lit(0)).alias("n"), "first", "last", F.coalesce("damaged", F.lit(0)).alias("damaged"))
    lake.append(sources, done) if lake.versions(sources) else lake.create(sources, done)
    total = lake.table(sources).join(F.broadcast(ids.select("source_id")), "source_id", "left_semi").agg(F.sum("n"), F.sum("damaged")).first()
    return {"logs": len(new), "messages": total[0], "damaged": total[1]}


# Projections of a snapshot into outside formats, replay plans and lineage events.

#: Formats by name: a function of (rows, root) that writes them.
PROJECTIONS: dict = {}


def register_projection(name: str, write) -> None:
    PROJECTIONS[name] = write


def project(rows: DataFrame, fmt: str, root: str | None = None, key: str = "key") -> dict:
    """A projection: its plan if no root is given (format, columns, rows, digest of the keys), else written there with the plan as manifest."""
    if fmt not in PROJECTIONS:
        raise KeyError(f"no projection {fmt!r}; known: {sorted(PROJECTIONS)}")
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64(key), F.lit(1_000_000_007))).alias("s")).first()
    plan = {"format": fmt, "columns": rows.columns, "rows": sums.n, "keys": int(sums.s or 0)}
    if root is not None:
        from .lake import Files

        PROJECTIONS[fmt](rows, f"{root.rstrip('/')}/data")
        import json

        Files(rows.sparkSession, root).create(f"{root.rstrip('/')}/manifest.json", json.dumps(plan))
    return plan


def check_projection(rows: DataFrame, root: str, key: str = "key") -> list[str]:
    """What a written projection's manifest and the rows disagree in; empty if nothing."""
    import json

    from .lake import Files

    files = Files(rows.sparkSession, root)
    if "manifest.json" not in files.names(root):
        return ["manifest"]
    wrote = json.loads(files.read(f"{root.rstrip('/')}/manifest.json"))
    now = project(rows, wrote["format"], None, key)
    return [k for k in now if now[k] != wrote.get(k)]


def replay_plan(scenarios: DataFrame, runs: DataFrame, pad: int = 0) -> DataFrame:
    """(source_uri, start, end, scenarios): the one slice of each source log that a set of scenarios (scenario_id, run_id, start, end) needs."""
    return scenarios.join(runs.select("run_id", "source_uri"), "run_id").groupBy("source_uri").agg((F.min("start") - pad).alias("start"), (F.max("end") + pad).alias("end"), F.count("*").alias("scenarios"))


def lineage_events(edges: DataFrame, space: str = "fathom", time: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(edge_id, event): an OpenLineage run event as JSON for each edge (edge_id, type, src, dst)."""
    name = lambda c: F.array(F.struct(F.lit(space).alias("namespace"), F.col(c).alias("name")))
    event = F.struct(
        F.lit("COMPLETE").alias("eventType"), F.lit(time).alias("eventTime"), F.struct(F.col("edge_id").alias("runId")).alias("run"), F.struct(F.lit(space).alias("namespace"), F.col("type").alias("name")).alias("job"),
        name("src").alias("inputs"), name("dst").alias("outputs"), F.lit(f"urn:{space}:producer").alias("producer"),
    )
    return edges.select("edge_id", F.to_json(event).alias("event"))


def decode_json(df: DataFrame, payload: str = "data", encoding: str = "encoding") -> DataFrame:
    """JSON payloads decoded; status decoded, failed (bad JSON) or raw (another encoding). Never raises."""
    text = F.col(payload).cast("string")
    good = F.expr(f"try_parse_json(cast(`{payload}` as string))").isNotNull()
    return df.withColumn("payload_json", F.when((F.col(encoding) == "json") & good, text)).withColumn("status", F.when(F.col(encoding) != "json", "raw").when(good, "decoded").otherwise("failed"))


def mp4_boxes(data: bytes, at: int = 0, end: int | None = None) -> list[tuple[str, int, int]]:
    """(type, start, end) of the boxes of a span, bodies only."""
    end, out = len(data) if end is None else end, []
    while at + 8 <= end:
        n, head = struct.unpack_from(">I", data, at)[0], 8
        kind = data[at + 4 : at + 8].decode("latin-1")
        if n == 1:
            n, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        n = n or end - at
        if n < head or at + n > end:
            break
        out.append((kind, at + head, at + n))
        at += n
    return out


def mp4_samples(data: bytes) -> dict:
    """Codec, sample count, timescale, duration and keyframes of a video's first track, from its tables alone."""

    def find(path: str, lo: int, hi: int) -> tuple[int, int] | None:
        for name in path.split("/"):
            got = next(((a, b) for k, a, b in mp4_boxes(data, lo, hi) if k == name), None)
            if got is None:
                return None
            lo, hi = got
        return lo, hi

    mdhd, stbl = find("moov/trak/mdia/mdhd", 0, len(data)), find("moov/trak/mdia/minf/stbl", 0, len(data))
    if not mdhd or not stbl:
        raise ValueError("no video track")
    v1 = data[mdhd[0]] == 1
    scale, span = struct.unpack_from(">IQ" if v1 else ">II", data, mdhd[0] + (20 if v1 else 12))
    stsd, stsz, stss = (find(n, *stbl) for n in ("stsd", "stsz", "stss"))
    keys = [k - 1 for k in struct.unpack_from(f">{struct.unpack_from('>I', data, stss[0] + 4)[0]}I", data, stss[0] + 8)] if stss else None
    n = struct.unpack_from(">I", data, stsz[0] + 8)[0] if stsz else 0
    return {"codec": data[stsd[0] + 12 : stsd[0] + 16].decode("latin-1") if stsd else "", "samples": n, "timescale": scale, "duration": span, "keyframes": list(range(n)) if keys is None else keys}


def enclosing_group(frames: DataFrame, groups: DataFrame, video: str = "video", frame: str = "frame") -> DataFrame:
    """Each frame with the byte range of the group of pictures that holds it; groups are (video, first, last, offset, bytes). A range join by video."""
    g = groups.withColumnRenamed(video, "__v")
    return frames.join(g, (F.col(video) == F.col("__v")) & F.col(frame).between(F.col("first"), F.col("last"))).drop("__v")


def read_mp4(spark: SparkSession, path: str) -> DataFrame:
    """(path, codec, samples, timescale, duration, keyframes, status) of the videos under a path, from their tables alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.mp4").load(path).select("path", "content")

    def rows(data):
        try:
            yield mp4_samples(data) | {"status": "read"}
        except struct.error as e:
            raise ValueError("a damaged table") from e

    return _per_file(files, T.StructType.fromDDL("path string, codec string, samples long, timescale long, duration long, keyframes array<long>, status string"), rows)


def read_db3(spark: SparkSession, path: str) -> DataFrame:
    """Messages of recordings in SQLite files (.db3) under a path, payloads raw; a file that is none has a single row of status failed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.db3").load(path).select("path", "content")

    def rows(data):
        import sqlite3
        from contextlib import closing

        try:
            with closing(sqlite3.connect(":memory:")) as db:
                db.deserialize(data)
                found = db.execute("select t.name, t.serialization_format, t.type, m.id, m.timestamp, m.data from messages m join topics t on t.id = m.topic_id order by m.timestamp, m.id")
                for topic, encoding, kind, n, at, payload in found:
                    yield {"topic": topic, "encoding": encoding, "schema": kind, "sequence": n, "log_time": at, "publish_time": at, "data": payload, "status": "raw"}
        except sqlite3.Error as e:
            raise ValueError("not a recording") from e

    return _per_file(files, MESSAGES, rows)


def mcap_bytes(messages) -> bytes:
    """A log of (topic, encoding, schema, sequence, log time, publish time, data) messages, in time order, without chunks."""
    rec = lambda op, b: bytes([op]) + struct.pack("<Q", len(b)) + b
    txt = lambda x: struct.pack("<I", len(x.encode())) + x.encode()
    out, schemas, channels = [MCAP_MAGIC, rec(1, txt("") + txt("fathom"))], {}, {}
    for topic, encoding, schema, seq, log, pub, data in sorted(messages, key=lambda m: (m[4], m[0], m[3])):
        if schema not in schemas:
            schemas[schema] = len(schemas) + 1
            out.append(rec(3, struct.pack("<H", schemas[schema]) + txt(schema) + txt("") + struct.pack("<I", 0)))
        c = (topic, encoding, schema)
        if c not in channels:
            channels[c] = len(channels) + 1
            out.append(rec(4, struct.pack("<HH", channels[c], schemas[schema]) + txt(topic) + txt(encoding) + struct.pack("<I", 0)))
        out.append(rec(5, struct.pack("<HIQQ", channels[c], seq, log, pub) + data))
    return b"".join([*out, rec(15, struct.pack("<I", 0)), rec(2, struct.pack("<QQI", 0, 0, 0)), MCAP_MAGIC])


def clips(messages: DataFrame, intervals: DataFrame, bucket: int) -> DataFrame:
    """(clip, n, lossless, mcap): a log for each interval (clip, run_id, start, end) of the messages (run_id, t, topic, encoding, schema, sequence, data) in it, both ends included.

    lossless is false where a message has no payload. A clip is put together in one task; intervals bound its size."""
    from ..operators.timeline import rows_in_intervals

    found = rows_in_intervals(messages, intervals, bucket)

    def pack(t):
        import pyarrow as pa

        rows = t.select(["topic", "encoding", "schema", "sequence", "t", "data"]).to_pylist()
        body = mcap_bytes([(r["topic"], r["encoding"] or "", r["schema"] or "", r["sequence"], r["t"], r["t"], r["data"] or b"") for r in rows])
        return pa.table({"clip": t.column("clip")[:1], "n": pa.array([len(rows)], pa.int64()), "lossless": [all(r["data"] is not None for r in rows)], "mcap": pa.array([body], pa.binary())})

    return found.groupBy("clip").applyInArrow(pack, f"clip {intervals.schema['clip'].dataType.simpleString()}, n long, lossless boolean, mcap binary")


def objects(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(path, length, modified, change): what is stored under a path, without reading it; against a known listing new, changed, same, or gone."""
    now = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    if known is None:
        return now.withColumn("change", F.lit("new"))
    old = known.select(F.col("path").alias("__p"), F.col("length").alias("__l"), F.col("modified").alias("__m"))
    both = now.join(old, F.col("path") == F.col("__p"), "full")
    same = (F.col("length") == F.col("__l")) & (F.col("modified") == F.col("__m"))
    change = F.when(F.col("__p").isNull(), "new").when(F.col("path").isNull(), "gone").when(same, "same").otherwise("changed")
    return both.select(F.coalesce("path", "__p").alias("path"), F.coalesce("length", "__l").alias("length"), F.coalesce("modified", "__m").alias("modified"), change.alias("change"))


def ingest_frames(lake, root: str, dataset: str, table: str = "frames") -> dict:
    """Take a robot dataset's frames into a lake table under the dataset's name; taking it again replaces what was taken before, in one version."""
    rows = read_frames(lake.spark, root).withColumn("dataset", F.lit(dataset))
    lake.replace_by(table, rows, "dataset") if lake.versions(table) else lake.create(table, rows)
    n = lake.table(table).where(F.col("dataset") == dataset).agg(F.count("*"), F.count_distinct("episode_index")).first()
    return {"frames": n[0], "episodes": n[1]}
