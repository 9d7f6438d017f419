"""Operators on small rows made by hand."""

import io
import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.functions import scalars as fn
from fathom.operators import curate as cu
from fathom.operators import graph as gr
from fathom.operators import search as se
from fathom.operators import timeline as tl
from fathom.plans import catalog  # noqa: F401
from fathom.queries import QUERIES
from fathom.sources import formats as fm
from fathom.sources.lake import Lake, LakeError
from fathom.streaming import streams as st


def test_durations():
    assert fn.parse_duration("250ms") == 250_000_000
    assert fn.parse_duration("0.5 s") == 500_000_000
    for bad in ("0s", "1.5ns", "3", "1h", ""):
        with pytest.raises(ValueError):
            fn.parse_duration(bad)


def test_alignment_of_rates(spark):
    """Two joint samples and three actions on a 20 Hz grid: joints linear, actions the previous one."""
    ms = 10**6
    joints = spark.createDataFrame([("r", 0, 0, 0.0), ("r", 1, 100 * ms, 100.0)], "run_id string, event_id long, t long, value double")
    acts = spark.createDataFrame([("r", 2, 0, 0.0), ("r", 3, 50 * ms, 50.0), ("r", 4, 100 * ms, 100.0)], "run_id string, event_id long, t long, value double")
    grid = tl.tick_grid(joints, 50 * ms)
    lin = {r.t: r for r in tl.align(grid, joints, ["run_id"], "linear", 60 * ms).collect()}
    assert [lin[t * ms].value for t in (0, 50, 100)] == [0.0, 50.0, 100.0]
    assert lin[50 * ms].status == "interpolated"
    prev = {r.t: r for r in tl.align(grid, acts, ["run_id"], "previous").collect()}
    assert prev[50 * ms].id == 3 and prev[50 * ms].value == 50.0


def test_markers_out_of_order(spark):
    s = 10**9
    ev = [("stop-1", "failure", 3 * s), ("start-0", "teleop_start", 0), ("dis", "disengagement", int(2.5 * s)), ("stop-0", "success", s), ("start-1", "teleop_start", 2 * s)]
    df = spark.createDataFrame([("r", *e) for e in ev], "run_id string, event_id string, topic string, t long")
    got = sorted((r.start, r.end) for r in tl.pair_markers(df, ["teleop_start"], ["success", "failure"]).collect())
    assert got == [(0, s), (2 * s, 3 * s)]


def test_windows_of_sample_log(spark):
    """Five messages over 0.2 s in 50 ms windows: four windows, the last one closed."""
    ms = 10**6
    rows = [("r", "/imu", 0, 0), ("r", "/imu", 100 * ms, 1), ("r", "/imu", 200 * ms, 2), ("r", "/camera", 50 * ms, 3), ("r", "/camera", 150 * ms, 4)]
    df = spark.createDataFrame(rows, "run_id string, topic string, t long, event_id long")
    got = tl.tumbling_windows(df, 50 * ms).orderBy("idx").collect()
    assert len(got) == 4 and got[-1].n == 2 and got[-1].topics == ["/camera", "/imu"]


def test_merge_gap(spark):
    df = spark.createDataFrame([("r", 0, 10), ("r", 11, 12), ("r", 3, 30), ("r", 50, 51)], "run_id string, start long, end long")
    assert sorted((r.start, r.end, r.n) for r in tl.merge_intervals(df).collect()) == [(0, 30, 3), (50, 51, 1)]
    assert tl.merge_intervals(df, 20).count() == 1


def test_curation_of_scenarios(spark):
    v = {"seed": [0.6, 0.8, 0, 0], "copy": [0.6003, 0.7998, 0, 0], "kin": [0.8, 0.6, 0, 0], "up": [0, 0, 0, 1.0], "side": [0, 0, 2.0, 0], "tilted": [0, 0, 3.0, 1.5]}
    df = spark.createDataFrame([(i, k, [float(x) for x in e], "s") for i, (k, e) in enumerate(v.items())], "id long, name string, v array<double>, shard string")
    pairs = cu.similar_pairs(df, 0.999, "id", "v", "shard")
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 1)]
    kept = {r.id for r in cu.representatives(df, pairs, "id", [F.col("id")]).where("kept").collect()}
    assert kept == {0, 2, 3, 4, 5}
    assert [r.id for r in cu.similar_to_seed(df, v["seed"], 3, "id", "v").collect()] == [0, 1, 2]
    with pytest.raises(ValueError):
        cu.similar_pairs(df, 0.9, "id", "v", "shard", most=3)


def brute_pairs(ids, x, t):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return {(min(ids[i], ids[at + j]), max(ids[i], ids[at + j])) for at in range(0, len(u), 500) for i, j in zip(*np.nonzero(u @ u[at : at + 500].T >= t)) if i != at + j}


def test_pairs_of_a_large_shard(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20100, 8)).round(3)
    x[20000:] = x[:100] * 2
    df = spark.createDataFrame([(i, v, "s") for i, v in enumerate(x.tolist())], "id long, v array<double>, shard string")
    got = [(r.a, r.b) for r in cu.similar_pairs(df, 0.999, "id", "v", "shard").collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(range(20100), x, 0.999)


def test_pairs_across_shards(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    x[200:] = x[0]
    df = spark.createDataFrame([(i, v, None if i % 3 == 0 else i % 3) for i, v in enumerate(x.tolist())] + [(900, None, 1), (901, [0.0] * 4, 1)], "id long, v array<double>, label int")
    want = brute_pairs(range(300), x, 0.9)
    got = [(r.a, r.b) for r in cu.similar_pairs(df, 0.9, "id", "v", block=40).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = {(r.a, r.b) for r in cu.similar_pairs(df, 0.9, "id", "v", "label", block=40).collect()}
    assert got == {(a, b) for a, b in want if a % 3 == b % 3 != 0}
    for shard in (None, "label"):
        one, two = (cu.representatives(df, f(df, 0.9, "id", "v", shard), "id", [F.desc("id")]) for f in (cu.similar_pairs, cu.similar_links))
        assert sorted(one.collect()) == sorted(two.collect())


def test_diversify_beyond_near_copies(spark, tmp_path):
    x = np.eye(16)[[0] * 200 + list(range(1, 13))] + 0.001
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(999, None)], "vec_id long, embedding array<float>")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.position: r.vec_id for r in QUERIES["diversify_topk"](spark, str(tmp_path)).collect()}
    assert got == {0: 0, **{i: 199 + i for i in range(1, 10)}}
    every = se.diverse_nearest(df, [1.0, *[0.0] * 15], 15, 0.3, "vec_id", "embedding")
    assert [r.vec_id for r in every.orderBy("position").collect()] == [0, *range(200, 212), 999]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in gr.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_reach_stops_at_filtered_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c"), ("c", "a")], "src string, dst string")
    root = spark.createDataFrame([("a",)], "node string")
    assert {r.node: r.depth for r in gr.reach(edges, root).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    allowed = spark.createDataFrame([("b",)], "node string")
    assert {r.node for r in gr.reach(edges, root, nodes=allowed).collect()} == {"a", "b"}


def test_lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    with pytest.raises(LakeError):
        lake.table("t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert lake.create("t", one) == 1
    assert lake.upsert("t", spark.createDataFrame([(2, "x"), (3, "c"), (3, "d")], "id long, v string"), "id") == 2
    assert sorted(map(tuple, lake.table("t").collect())) == [(1, "a"), (2, "x"), (3, "d")]
    assert sorted(map(tuple, lake.table("t", 1).collect())) == [(1, "a"), (2, "b")]
    lake.tag("t", "first", 1)
    assert lake.append("t", one) == 3 and lake.table("t").count() == 5
    assert lake.delete("t", "id = 1") == 4 and lake.table("t").count() == 3
    assert lake.add_column("t", spark.createDataFrame([(2, 0.5)], "id long, score double"), "id", "score") == 5
    assert lake.prune("t") == [2, 3, 4]
    assert lake.table("t", "first").count() == 2 and lake.versions("t") == [1, 5]
    with pytest.raises(LakeError):
        lake.append("t", spark.createDataFrame([(1,)], "other long"))
    with pytest.raises(LakeError):
        lake.snapshot("t", spark.createDataFrame([(99,)], "id long"), "id", {"train": 1.0})


def make_mcap(messages, chunked):
    rec = lambda op, b: bytes([op]) + struct.pack("<Q", len(b)) + b
    s = lambda x: struct.pack("<I", len(x)) + x.encode()
    body = rec(3, struct.pack("<H", 1) + s("Imu") + s("jsonschema") + struct.pack("<I", 0)) + rec(4, struct.pack("<HH", 7, 1) + s("/imu") + s("json") + struct.pack("<I", 0))
    for i, (t, p) in enumerate(messages):
        body += rec(5, struct.pack("<HIQQ", 7, i, t, t) + p)
    if chunked:
        import zstandard

        z = zstandard.ZstdCompressor().compress(body)
        body = rec(6, struct.pack("<QQQI", 0, 9, len(body), 0) + s("zstd") + struct.pack("<Q", len(z)) + z)
    return fm.MCAP_MAGIC + rec(1, s("") + s("")) + body + fm.MCAP_MAGIC


@pytest.mark.parametrize("chunked", [False, True])
def test_mcap(spark, tmp_path, chunked):
    (tmp_path / "a.mcap").write_bytes(make_mcap([(5, b'{"gyro_z": 0.1}'), (6, b"{bad")], chunked))
    (tmp_path / "b.mcap").write_bytes(b"nothing")
    got = fm.decode_json(fm.read_mcap(spark, str(tmp_path))).orderBy("log_time").collect()
    ok = [r for r in got if r.topic]
    assert [(r.topic, r.schema, r.log_time, r.status) for r in ok] == [("/imu", "Imu", 5, "decoded"), ("/imu", "Imu", 6, "failed")]
    assert json.loads(ok[0].payload_json) == {"gyro_z": 0.1} and len(got) == 3


def test_mp4_tables():
    box = lambda k, b: struct.pack(">I", len(b) + 8) + k + b
    stbl = box(b"stsd", struct.pack(">II", 0, 1) + box(b"avc1", b"\0" * 8)) + box(b"stsz", struct.pack(">III", 0, 0, 5) + b"\0" * 20) + box(b"stss", struct.pack(">IIII", 0, 2, 1, 4))
    mdia = box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 30, 150) + b"\0" * 4) + box(b"minf", box(b"stbl", stbl))
    got = fm.mp4_samples(box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"mdia", mdia))))
    assert got == {"codec": "avc1", "samples": 5, "timescale": 30, "duration": 150, "keyframes": [0, 3]}


def test_robot_dataset_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, 0.0, [1.0]), (0, 1, 0.1, [2.0]), (1, 0, 0.0, [3.0])], "ep long, fr long, ts double, state array<double>")
    fm.write_frames(df, str(tmp_path / "d"), "ep", "fr", "ts", 10.0)
    assert fm.read_frames(spark, str(tmp_path / "d")).count() == 3
    info = fm.read_info(spark, str(tmp_path / "d")).first()
    assert (info.total_episodes, info.total_frames, info.fps) == (2, 3, 10.0)


def test_interval_manifests(spark, tmp_path):
    p = tmp_path / "i.jsonl"
    p.write_text('{"run_id":"r","from_timestamp_ns":0,"to_timestamp_ns":5,"external_id":"x"}\n{"run_id":"q","from_timestamp_ns":0,"to_timestamp_ns":5,"external_id":"x"}\n')
    runs = spark.createDataFrame([("r", 0, 9)], "run_id string, start long, end long")
    got = {r.run_id: r.problem for r in fm.check_intervals(fm.read_intervals(spark, str(p)), runs).collect()}
    assert got == {"r": "duplicate-id", "q": "unknown-run"}


def test_tar_shards(spark):
    import tarfile

    df = spark.createDataFrame([(i, f"text {i}") for i in range(25)], "id long, txt string")
    got = {r.shard: r for r in fm.tar_shards(df, "id", ["txt"], 10).collect()}
    assert {k: r.n for k, r in got.items()} == {0: 10, 1: 10, 2: 5}
    assert tarfile.open(fileobj=io.BytesIO(got[2].tar)).extractfile("24.txt").read() == b"text 24"


def test_streams(spark, tmp_path):
    rows = [(1, 0, "start"), (1, 5, "stop"), (2, 3, "stop"), (2, 4, "start"), (1, 9, "start"), (1, 12, "stop")]
    spark.createDataFrame(rows, "k long, t long, kind string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, t long, kind string").parquet(str(tmp_path / "in"))
    got = st.run_to_end(st.paired_markers(stream, "k", "t", "kind", ("start",), ("stop",)), "pairs", str(tmp_path / "c1"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 5), (1, 9, 12)]
    lake = Lake(spark, str(tmp_path / "lake"))
    q = stream.writeStream.foreachBatch(st.upsert_into(lake, "s", "t")).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert lake.table("s").count() == 6
    timed = stream.withColumn("ts", F.timestamp_seconds("t"))
    sess = st.run_to_end(st.sessions(timed, "ts", "k", "6 seconds", "0 seconds"), "sess", str(tmp_path / "c3"), "complete")
    assert sorted((r.k, r.n) for r in sess.collect()) == [(1, 4), (2, 2)]
