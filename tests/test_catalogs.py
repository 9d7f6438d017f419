"""Catalogs, resumable jobs, listings, recordings in SQLite, datasets, streams and the command line."""

import json
import os
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from fathom.operators import curate as cu
from fathom.operators import filters as fl
from fathom.operators.jobs import ColumnJob
from fathom.sources import formats as fm
from fathom.sources.catalogs import Catalog, CatalogError
from fathom.sources.lake import Lake
from fathom.streaming import streams as st

PLANS = {"": ["proposed"], "proposed": ["approved", "rejected"], "approved": ["done"]}


def test_records_states_and_pages(spark, tmp_path):
    c = Catalog(Lake(spark, str(tmp_path)), "plan", PLANS)
    ids = [c.record("rebuild", {"n": i}, 10 * i, [f"h{i % 2}"]) for i in range(5)]
    assert c.record("rebuild", {"n": 0}, 99) == ids[0] and c.get(ids[0])["created_at"] == 0 and c.last()["body"] == {"n": 4} and c.last("none") is None
    c.move(ids[0], "approved", 20)
    with pytest.raises(CatalogError, match="can't become"):
        c.move(ids[1], "done", 20)
    with pytest.raises(CatalogError):
        c.get("plan-none")
    states = lambda **a: {r.record_id: r.state for r in c.state(**a).collect()}
    assert states()[ids[0]] == "approved" and states(asof=15) == {ids[0]: "proposed", ids[1]: "proposed"}
    assert {r.record_id for r in c.find("h1").collect()} == {ids[1], ids[3]}
    first, token = c.page(2)
    second, token2 = c.page(2, token)
    third, end = c.page(2, token2)
    assert [r.record_id for p in (first, second, third) for r in p.collect()] == ids[::-1] and end is None
    for bad in (lambda: c.page(3, token), lambda: c.page(2, token, name="other"), lambda: c.page(2, "xx")):
        with pytest.raises(CatalogError):
            bad()
    holds = spark.createDataFrame([(ids[0],)], "record_id string")
    assert {r.record_id: r.verdict for r in c.verdicts(2, 25, holds).collect()} == {ids[0]: "protected", ids[1]: "expired", ids[2]: "expired", ids[3]: "kept", ids[4]: "kept"}
    assert c.expire(2, 25, holds) == 2 and c.expire(2, 25, holds) == 0 and c.state().count() == 5
    c.export(str(tmp_path / "out"))
    assert {r.state for r in spark.read.json(str(tmp_path / "out")).collect()} == {"approved", "proposed"}


def test_a_job_goes_on(spark, tmp_path):
    calls = []

    def work(df):
        calls.append(1)
        return df.select("id", (F.col("id") * 2).alias("twice"))

    df = spark.range(40)
    job = ColumnJob(df, str(tmp_path / "j"), "id", work, 4)
    assert job.run(1) == 3
    with pytest.raises(RuntimeError, match="3 of 4 parts"):
        job.result()
    assert ColumnJob(df, str(tmp_path / "j"), "id", work, 4).run() == 0 and len(calls) == 4
    assert job.result().where("twice = 2 * id").count() == 40


def test_listing(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    for n in "abc":
        (d / f"{n}.bin").write_bytes(b"x")
    known = spark.createDataFrame(fm.objects(spark, str(d)).collect())
    (d / "a.bin").write_bytes(b"longer")
    (d / "b.bin").unlink()
    (d / "e.bin").write_bytes(b"x")
    assert {r.path[-5:]: r.change for r in fm.objects(spark, str(d), known).collect()} == {"a.bin": "changed", "b.bin": "gone", "c.bin": "same", "e.bin": "new"}


def test_recordings_in_sqlite(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "r.db3")
    db.executescript("create table topics(id integer, name text, type text, serialization_format text); create table messages(id integer, topic_id integer, timestamp integer, data blob); insert into topics values (1, '/chatter', 'std_msgs/msg/String', 'cdr'); insert into messages values (2, 1, 20, x'0102'), (1, 1, 10, x'00');")
    db.close()
    (tmp_path / "bad.db3").write_bytes(b"no database")
    got = sorted((r.topic or "", r.log_time or 0, bytes(r.data or b""), r.status) for r in fm.read_db3(spark, str(tmp_path)).collect())
    assert got == [("", 0, b"", "failed"), ("/chatter", 10, b"\0", "raw"), ("/chatter", 20, b"\1\2", "raw")]


def test_videos_as_rows(spark, tmp_path):
    box = lambda k, b: struct.pack(">I", len(b) + 8) + k + b
    stbl = box(b"stsd", struct.pack(">II", 0, 1) + box(b"avc1", b"\0" * 8)) + box(b"stsz", struct.pack(">III", 0, 0, 5) + b"\0" * 20)
    mdia = box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 30, 150) + b"\0" * 4) + box(b"minf", box(b"stbl", stbl))
    (tmp_path / "v.mp4").write_bytes(box(b"moov", box(b"trak", box(b"mdia", mdia))))
    (tmp_path / "w.mp4").write_bytes(b"nothing")
    assert sorted((r.status, r.samples, r.codec) for r in fm.read_mp4(spark, str(tmp_path)).collect()) == [("failed", None, None), ("read", 5, "avc1")]


def test_datasets_into_a_lake(spark, tmp_path):
    lake = Lake(spark, str(tmp_path / "lake"))
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.1), (1, 0, 0.0)], "ep long, fr long, ts double")
    fm.write_frames(df, str(tmp_path / "d"), "ep", "fr", "ts", 10.0)
    for _ in range(2):
        assert fm.ingest_frames(lake, str(tmp_path / "d"), "one") == {"frames": 3, "episodes": 2}
    assert fm.ingest_frames(lake, str(tmp_path / "d"), "two")["frames"] == 3 and lake.table("frames").count() == 6


def test_late_rows_are_counted(spark, tmp_path):
    schema = "at timestamp, k string"
    for i, rows in enumerate(([("2024-01-02 00:00:00", "a")], [("2024-01-02 00:00:05", "a")], [("2024-01-01 00:00:00", "a")])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps({"at": t, "k": k}) for t, k in rows))
        os.utime(tmp_path / "in" / f"{i}.json", (1_700_000_000 + 10 * i, 1_700_000_000 + 10 * i))  # files are taken in this order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    q = st.tumbling_counts(stream, "at", "k", "1 minute", "10 seconds").writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert st.late_rows(q) == 1


def test_small_operators(spark):
    df = spark.createDataFrame([("r", ["quarantined"]), ("r", []), ("q", ["ok"])], "run string, flags array<string>")
    assert [r.run for r in fl.quarantined(df, "run", "flags").collect()] == ["r"]
    one = spark.range(1).select(cu.confidence_margin(F.lit(0.9), F.lit("confidence"), 0.5).alias("low"), cu.confidence_margin(F.lit(0.1), F.lit("confidence"), 0.5).alias("over")).first()
    assert abs(one.low - 0.1) < 1e-9 and one.over is None


def test_command_line(spark, capsys):
    from conftest import SF

    from fathom.__main__ import main

    assert main(["list"]) == 0 and "scenario_windows (SQL)" in capsys.readouterr().out
    assert main(["run", "split_counts", "--data", SF, "--limit", "2"]) == 0 and main(["explain", "split_counts", "--data", SF]) == 0
    with pytest.raises(SystemExit):
        main(["run", "nothing", "--data", SF])
