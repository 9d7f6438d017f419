"""Sources, commits, search errors, episodes, alignment, lineage and selections on small rows made by hand."""

import json
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from fathom.functions import payloads as pl
from fathom.functions import scalars as fn
from fathom.operators import alignment as al
from fathom.operators import blocks
from fathom.operators import episodes as ep
from fathom.operators import graph as gr
from fathom.operators import lineage as ln
from fathom.operators import search as se
from fathom.operators import selections as sel
from fathom.operators import training as tr
from fathom.sources import formats as fm
from fathom.sources.lake import Lake, LakeError

# logs


def rec(op, b):
    return bytes([op]) + struct.pack("<Q", len(b)) + b


def txt(x):
    return struct.pack("<I", len(x)) + x.encode()


HEAD = fm.MCAP_MAGIC + rec(1, txt("") + txt(""))
NAMES = rec(3, struct.pack("<H", 1) + txt("Imu") + txt("jsonschema") + struct.pack("<I", 0)) + rec(4, struct.pack("<HH", 7, 1) + txt("/imu") + txt("json") + struct.pack("<I", 0)) + rec(4, struct.pack("<HH", 8, 1) + txt("/cam") + txt("cbor") + struct.pack("<I", 0))


def message(channel, t, data):
    return rec(5, struct.pack("<HIQQ", channel, t, t, t) + data)


def chunk(body, kind, crc=None, spoil=False):
    import pyarrow as pa
    import zstandard

    z = zstandard.ZstdCompressor().compress(body) if kind == "zstd" else pa.Codec("lz4").compress(body).to_pybytes() if kind == "lz4" else body
    if spoil:
        z = z[: len(z) // 2]
    return rec(6, struct.pack("<QQQI", 0, 9, len(body), zlib.crc32(body) if crc is None else crc) + txt(kind) + struct.pack("<Q", len(z)) + z)


def test_chunks_and_damage(spark, tmp_path):
    m = [message(7, t, b'{"gyro_z": 1}') for t in range(6)]
    files = {
        "good": HEAD + chunk(NAMES + m[0], "zstd") + chunk(m[1], "lz4") + chunk(m[2], "") + fm.MCAP_MAGIC,
        "crc": HEAD + chunk(NAMES + m[0], "lz4") + chunk(m[1], "lz4", crc=5) + chunk(m[2], "lz4") + fm.MCAP_MAGIC,
        "codec": HEAD + NAMES + m[0] + chunk(m[1], "brotli") + m[2] + fm.MCAP_MAGIC,
        "spoilt": HEAD + NAMES + chunk(m[0], "lz4", spoil=True) + chunk(m[1], "zstd", spoil=True) + m[2] + fm.MCAP_MAGIC,
        "cut": HEAD + NAMES + m[0] + m[1][:-3],
        "short": HEAD + NAMES + rec(5, b"abc") + m[0] + fm.MCAP_MAGIC,
        "none": b"not a log",
    }
    for name, data in files.items():
        (tmp_path / f"{name}.mcap").write_bytes(data)
    got = {}
    for r in fm.read_mcap(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[1][:-5], []).append(r.log_time if r.status == "raw" else r.status)
    want = {"good": [0, 1, 2], "crc": [0, "damaged:crc", 2], "codec": [0, "damaged:codec", 2], "spoilt": ["damaged:chunk", "damaged:chunk", 2], "cut": [0, "damaged:cut"], "short": ["damaged:record", 0], "none": ["failed"]}
    assert got == want
    assert fm.read_mcap(spark, str(tmp_path), check=False).where("path like '%crc.mcap' and status = 'raw'").count() == 3
    look = {(r.path.rsplit("/", 1)[1], r.topic): (r.n, r.first, r.last, r.damaged, r.readable) for r in fm.inspect_mcap(spark, str(tmp_path)).collect()}
    assert look[("good.mcap", "/imu")] == (3, 0, 2, 0, True) and look[("spoilt.mcap", "/imu")] == (1, 2, 2, 2, True) and look[("none.mcap", None)][3] == 1


def test_attachments_and_metadata(spark, tmp_path):
    att = rec(9, struct.pack("<QQ", 5, 6) + txt("map.png") + txt("image/png") + struct.pack("<Q", 3) + b"abc" + struct.pack("<I", 0))
    pairs = txt("robot") + txt("r2")
    meta = rec(12, txt("setup") + struct.pack("<I", len(pairs)) + pairs)
    (tmp_path / "a.mcap").write_bytes(HEAD + NAMES + att + meta + rec(15, struct.pack("<I", 0)) + att)
    got = {r.kind: r for r in fm.read_mcap_extras(spark, str(tmp_path)).collect()}
    assert (got["attachment"].name, got["attachment"].log_time, bytes(got["attachment"].data)) == ("map.png", 5, b"abc") and got["metadata"].pairs == {"robot": "r2"} and len(got) == 2


def test_ingest_is_idempotent(spark, tmp_path):
    lake, logs = Lake(spark, str(tmp_path / "lake")), tmp_path / "logs"
    logs.mkdir()
    body = HEAD + NAMES + message(7, 1, b'{"a": 1}') + message(8, 2, bytes([0xA1, 0x61, 0x61, 0x18, 0x20])) + message(7, 3, b"{bad")
    (logs / "a.mcap").write_bytes(body + fm.MCAP_MAGIC)
    (logs / "copy.mcap").write_bytes(body + fm.MCAP_MAGIC)
    assert fm.ingest_mcap(lake, str(logs)) == {"logs": 1, "messages": 3, "damaged": 0}
    assert fm.ingest_mcap(lake, str(logs)) == {"logs": 0, "messages": 0, "damaged": 0}
    (logs / "b.mcap").write_bytes(body[:-2])
    assert fm.ingest_mcap(lake, str(logs)) == {"logs": 1, "messages": 2, "damaged": 1}
    rows = {(r.topic, r.log_time): (r.payload_json, r.decode_status) for r in lake.table("observations").collect()}
    assert rows[("/cam", 2)] == ('{"a": 32}', "decoded") and rows[("/imu", 3)] == (None, "failed") and lake.table("observations").count() == 5
    assert [r.reason for r in lake.table("quarantine").collect()] == ["damaged:cut"] and lake.table("sources").count() == 2


@pytest.mark.parametrize("raw,want", [
    (bytes([0x83, 1, 0x20, 0xF6]), [1, -1, None]), (bytes([0xBF, 0x61, 0x61, 0x9F, 0xF5, 0xFF, 0xFF]), {"a": [True]}), (bytes([0xFB]) + struct.pack(">d", 1.5), 1.5), (bytes([0xC1, 0x1A, 0, 0, 1, 0]), 256),
    (bytes([0x7F, 0x61, 0x61, 0x61, 0x62, 0xFF]), "ab"), (bytes([0x42, 1, 2]), b"\1\2"), (bytes([0xF9, 0x3E, 0]), 1.5),
])
def test_cbor(raw, want):
    assert pl.cbor(raw) == want
    for bad in (raw[:-1], raw + b"\0"):
        with pytest.raises(ValueError):
            pl.cbor(bad)


@pytest.mark.parametrize("raw,want", [
    (bytes([0x93, 1, 0xFF, 0xC0]), [1, -1, None]), (bytes([0x81, 0xA1, 0x61, 0xC3]), {"a": True}), (bytes([0xCB]) + struct.pack(">d", 1.5), 1.5), (bytes([0xCD, 1, 0]), 256), (bytes([0xD1, 0xFF, 0]), -256),
    (bytes([0xC4, 2, 1, 2]), b"\1\2"), (bytes([0xD9, 2, 0x61, 0x62]), "ab"), (bytes([0xDC, 0, 1, 5]), [5]),
])
def test_msgpack(raw, want):
    assert pl.msgpack(raw) == want
    for bad in (raw[:-1], raw + b"\0", b"\xc1"):
        with pytest.raises(ValueError):
            pl.msgpack(bad)


def test_typed_messages(spark):
    vec = '{"x":1,"y":2,"z":3}'
    rows = [
        ("nav_msgs/Odometry", f'{{"pose":{{"pose":{{"position":{vec},"orientation":{{}}}}}},"twist":{{"twist":{{"linear":{vec},"angular":{vec}}}}},"child_frame_id":"b"}}'), ("other", f'{{"twist":{{"linear":{vec},"angular":{vec}}}}}'),
        (None, '{"latitude":1,"longitude":2,"altitude":3}'), ("sensor_msgs/NavSatFix", '{"latitude":"x","longitude":2}'), ("sensor_msgs/Image", None), ("x", '{"data":"","format":"h264","is_key_frame":true}'), ("x", '{"data":"","format":"jpeg"}'), (None, "[1]"), (None, None),
    ]
    got = [(r.modality, r.state_vector, r.action_vector) for r in pl.typed_fields(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, schema string, payload_json string")).orderBy("i").collect()]
    v = [1.0, 2.0, 3.0]
    assert got[0] == ("odometry", [*v, 0.0, 0.0, 0.0, 1.0], v + v) and got[1] == ("twist", None, v + v) and got[2] == ("gps", v, None) and got[3] == ("gps", None, None)
    assert [g[0] for g in got[4:]] == ["image", None, "image", None, None]


def test_scalars_of_bytes(spark):
    df = spark.createDataFrame([(1, b"\xff" * 8), (2, b""), (3, None), (4, bytes(range(0, 256, 2)))], "i int, b binary")
    got = {r.i: r for r in df.select("i", fn.image_caption(F.col("b")).alias("c"), fn.image_embedding(F.col("b"), 4).alias("v")).collect()}
    assert got[1].c == "bright,low-contrast,smooth" and got[1].v == [0.5] * 4 and got[2].c == "empty,unknown-contrast,unknown-texture" and got[2].v == [0.0] * 4 and got[3].c is None and got[4].c == "mid-tone,high-contrast,smooth"
    one = spark.range(1).select(fn.l2_normalise(F.array(F.lit(3.0), F.lit(4.0))).alias("n"), fn.interpolate(F.array(F.lit(0.0)), F.array(F.lit(2.0)), F.lit(0.25)).alias("x"), fn.parse_label(F.lit("a=1|b=2")).alias("m"), fn.caption(F.lit(3), F.array(F.lit("a")), F.lit(2e6)).alias("c")).first()
    assert one.n == [0.6, 0.8] and one.x == [0.5] and one.m == {"a": "1", "b": "2"} and one.c == "3 observations on a over 2.0 ms"


# lake and graph


def test_no_commit_is_lost(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    one = lambda *r: spark.createDataFrame(list(r), "id long, x string")
    lake.create("t", one((1, "a"), (2, "b")))
    with pytest.raises(LakeError):
        lake.create("t", one((1, "a")))
    put, raced = lake._put, []

    def racing(name, version, parts, schema):
        """Another writer appends just before each first try."""
        if name == "t" and not raced:
            raced.append(1)
            Lake(spark, str(tmp_path)).append("t", one((9, "late")))
        return put(name, version, parts, schema)

    for work in (lambda: lake.upsert("t", one((2, "B")), "id"), lambda: lake.delete("t", "id = 1"), lambda: lake.add_column("t", one((9, "late")).withColumnRenamed("x", "y"), "id", "y"), lambda: lake.compact("t", 1)):
        if "y" in lake.table("t").columns:
            raced.append(1)  # the other writer's rows lack the new column
        lake._put = racing
        work()
        lake._put = put
        raced.clear()
    got = sorted((r.id, r.x, r.y) for r in lake.table("t").collect())
    assert got == [(2, "B", None), (9, "late", "late"), (9, "late", "late"), (9, "late", "late")]
    assert lake.take("t", one((2, "q")), "id", ["x"]).collect()[0].x == "B"
    assert lake.maintain("t", [1], 1) and set(lake.versions("t")) == {1, lake.versions("t")[-1]}
    lake.replace_by("t", lake.table("t").where("id = 2").withColumn("x", F.lit("C")), "id")
    assert lake.table("t").where("id = 2").first().x == "C" and lake.table("t").count() == 4


def test_a_chain_of_200_levels(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(200, 0)], "src long, dst long")
    got = gr.reach(edges, spark.createDataFrame([(0,)], "node long"))
    assert got.count() == 201 and got.agg(F.max("depth")).first()[0] == 200
    assert gr.reach(edges, spark.createDataFrame([(0,)], "node long"), max_depth=5).count() == 6


# search


def test_search_errors_and_modes(spark):
    rows = [(i, t, v, n) for i, (t, v, n) in enumerate([("red fish", [1.0, 0.0], 3), ("blue fish", [0.9, 0.1], 2), ("red red bird", [0.0, 1.0], 1), ("stone", None, 0)])]
    df = spark.createDataFrame(rows, "id long, text string, embedding array<double>, n long")
    index = se.TextIndex(df, "id", "text", 3)
    keys = lambda **a: [r.id for r in se.search(df, a.pop("mode"), "id", **a).orderBy("rank").collect()]
    assert keys(mode="scalar", order=["n"], limit=2) == [3, 2] and keys(mode="scalar", order=["n"], where=F.col("n") > 1) == [1, 0]
    assert keys(mode="text", query="RED") == [2, 0] and keys(mode="text", query="red", index=index, version=3) == [2, 0] and keys(mode="text", query="fish", where=F.col("n") > 2) == [0]
    assert keys(mode="vector", vector=[1.0, 0.0], limit=3) == [0, 1, 2] and keys(mode="vector", vector=[1.0, 0.0], limit=2, diversify=0.9) == [0, 2]
    assert keys(mode="hybrid", query="bird", vector=[0.0, 1.0], limit=1) == [2]
    for bad in (
        {"mode": "text", "query": " !"}, {"mode": "guess"}, {"mode": "vector"}, {"mode": "vector", "vector": [1.0], "embedding": "none"}, {"mode": "vector", "vector": [1.0], "route": "ann"}, {"mode": "text", "query": "a", "index": index, "version": 4},
        {"mode": "scalar", "limit": 0}, {"mode": "scalar", "route": "best"},
    ):
        with pytest.raises(se.SearchError):
            se.search(df, bad.pop("mode"), "id", **bad)
    with pytest.raises(se.SearchError):
        se.search(df.limit(0), "scalar", "id")


def test_blocks_and_lists(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(blocks, "VECTORS", 50)
    monkeypatch.setattr(blocks, "QUERIES", 4)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(300, 6)), 1)
    x[100:160] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "id long, v array<double>")
    asks = df.where("id % 30 = 0")
    got = {}
    for r in blocks.top_each(df, asks, 7, "id", "v").orderBy("query", "rank").collect():
        got.setdefault(r.query, []).append(r.id)
    for q in range(0, 300, 30):
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 9)
        assert got[q] == sorted((i for i in range(300) if i != q), key=lambda i: (d[i], i))[:7]
    index = se.IvfIndex(df.where("id < 900"), "id", "v", 8)
    probes, reached = index.probes_for(asks.where("id < 900"), 7, 0.9)
    assert reached >= 0.9 and probes <= 8 and index.nearest(asks.where("id < 900"), 7, 8).count() == 70
    one = se.search(df.where("id < 900"), "vector", "id", vector=x[5].tolist(), embedding="v", ann=index, probes=8, limit=3).orderBy("rank").first()
    assert one.id == 5


# episodes, alignment, lineage, selections


def test_episode_life(spark):
    log = spark.createDataFrame([("a", 1, "create", None), ("a", 5, "supersede", "b"), ("b", 5, "create", None), ("c", 2, "create", None), ("c", 3, "clear", None)], "episode_id string, at long, kind string, superseded_by string")
    assert {r.episode_id: (r.state, r.superseded_by) for r in ep.alive(log).collect()} == {"a": ("superseded", "b"), "b": ("active", None), "c": ("cleared", None)}
    assert {r.episode_id: r.state for r in ep.alive(log, asof=2).collect()} == {"a": "active", "c": "active"}
    runs = spark.createDataFrame([("r", 0, 9)], "run_id string, start long, end long")
    rows = spark.createDataFrame([("r", 1, 5, "x"), ("q", 0, 5, "y")], "run_id string, from_timestamp_ns long, to_timestamp_ns long, external_id string")
    with pytest.raises(ValueError, match="1 unknown-run"):
        ep.from_intervals(fm.check_intervals(rows, runs))
    assert [(r.start, r.end) for r in ep.from_intervals(fm.check_intervals(rows.where("run_id = 'r'"), runs)).collect()] == [(1, 5)]


def test_view_recipes(spark):
    ms = 10**6
    rows = [(1, "j", 0, 0.0), (2, "j", 100 * ms, 100.0), (3, "a", 5 * ms, 0.0), (4, "a", 55 * ms, 50.0), (5, "a", 105 * ms, 100.0)]
    obs = spark.createDataFrame([("r", *r) for r in rows], "run_id string, event_id long, topic string, t long, value double").where("t <= 105000000")
    view = al.create_view(obs.where("t <= 100000000").unionByName(obs.where("t > 100000000")), {"j": al.Stream("linear", 60 * ms), "a": al.Stream("previous", None, 5 * ms)}, 20.0)
    got = {(r.topic, r.t // ms): (r.value, r.error) for r in view.collect()}
    assert got[("j", 50)][0] == 50.0 and got[("a", 50)] == (50.0, 0) and got[("a", 100)] == (100.0, 0) and len(got) == 6
    for bad in ({}, {"j": al.Stream("best")}):
        with pytest.raises(ValueError):
            al.create_view(obs, bad, 20.0)
    assert al.sub_frame_bound(10) == 5 and al.sub_frame_bound(1) == 1 and al.sub_frame_bound(10**9, 7) == 7 and al.sub_frame_bound(10**9) == 10**6


def test_selections(spark, tmp_path):
    df = spark.createDataFrame([(i, ["all", f"k:{i % 2}"], i % 3) for i in range(10)], "id long, tags array<string>, g long")
    base = sel.Selection(df, "id")
    some = base.scope(tag="k:1", g=0)
    assert sorted(r.id for r in some.ids().collect()) == [3, 9] and base.report() == {"n": 10, "steps": []} and some.report()["steps"] == ["scope"]
    assert sel.stale({"a": 1, "b": 2}, {"a": 1, "b": 3}) == ["b"]
    with pytest.raises(KeyError):
        sel.compare(df, df, "id", "g", ["none"])
    vec = spark.createDataFrame([(i, [float(i % 5), float(i % 7)], "ab"[i % 2]) for i in range(40)], "id long, v array<double>, shard string")
    job = sel.DedupJob(vec, str(tmp_path / "job"), 0.999, "id", "v", "shard")
    assert job.run(1) == 1
    with pytest.raises(RuntimeError):
        job.memberships()
    assert job.run() == 0 and job.memberships().count() == 40
    picked, report = sel.constrained_sample(vec, 6, "id", "v", "shard", {"a": 2}, {"b": 1, "c": 3})
    assert picked.count() == 6 and {r["constraint"]: r["status"] for r in report} == {"min:a": "satisfied", "max:b": "satisfied", "max:c": "satisfied"}
    _, short = sel.constrained_sample(vec, 3, "id", "v", "shard", {"z": 1})
    assert short[0] == {"constraint": "min:z", "wanted": 1, "got": 0, "feasible_count": 0, "status": "violated"}


def test_lineage_refresh_twice(spark):
    e = ln.edges([(spark.createDataFrame([(1, 2), (3, 4), (5, None)], "a long, b long"), "made", "x", "a", "y", "b")])
    empty = e.limit(0)
    assert {r.action for r in ln.refresh(empty, e).collect()} == {"insert"} and {r.action for r in ln.refresh(e, e).collect()} == {"keep"} and e.count() == 2
    assert ln.needs_refresh(None, {"t": 1}) and not ln.needs_refresh({"t": 1}, {"t": 1})
    pack = ln.evidence_pack(e, spark.createDataFrame([("y:2",)], "node string"), ln.artifacts({"x": (spark.createDataFrame([(1, "one")], "k long, n string"), "k", "n")}))
    assert {(r.node, r.name) for r in pack.collect()} == {("y:2", None), ("x:1", "one")} and len({r.pack_id for r in pack.collect()}) == 1


def test_projection_and_records(spark, tmp_path):
    fm.register_projection("lines", fm.to_lines)
    df = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "key long, v string")
    plan = fm.project(df, "lines")
    assert plan["rows"] == 5 and fm.project(df, "lines", str(tmp_path / "p")) == plan and fm.check_projection(df, str(tmp_path / "p")) == [] and fm.check_projection(df.limit(4), str(tmp_path / "p")) == ["rows", "keys"]
    assert fm.check_projection(df, str(tmp_path / "none")) == ["manifest"]
    assert spark.read.json(str(tmp_path / "p/data")).count() == 5
    with pytest.raises(KeyError):
        fm.project(df, "other")
    (tmp_path / "b.json").write_text(json.dumps({"rows": [{"id": 1, "label": "x"}, {"id": 2}]}))
    assert [(r.id, r.label) for r in fm.read_records(spark, str(tmp_path / "b.json"), "id: long, label: string", "rows").collect()] == [(1, "x"), (2, None)]
    fm.write_steps(spark.createDataFrame([(0, 0), (0, 1), (1, 0)], "ep long, fr long"), str(tmp_path / "s"), "ep", "fr")
    assert spark.read.parquet(str(tmp_path / "s/episodes")).where("is_last").count() == 2
    groups = spark.createDataFrame([("v", 0, 4, 100, 50), ("v", 5, 9, 150, 60)], "video string, first long, last long, offset long, bytes long")
    assert [r.offset for r in fm.enclosing_group(spark.createDataFrame([("v", 5)], "video string, frame long"), groups).collect()] == [150]


def test_datasets_refuse_gaps(spark):
    rows = spark.createDataFrame([(i, i * 2) for i in range(6)], "id long, x long")
    with pytest.raises(ValueError, match="members without rows"):
        tr.dataset(rows.union(spark.createDataFrame([(99, 1)], "id long, x long")), rows, "id", ["x"], ["x"])
    with pytest.raises(ValueError, match="resume at 7 of 6"):
        tr.dataset(rows, rows, "id", ["x"], ["x"], resume=7)
    assert [r.id for r in tr.dataset(rows, rows, "id", ["x"], ["x"], workers=2, worker=1).orderBy("step").collect()] == [1, 3, 5]

